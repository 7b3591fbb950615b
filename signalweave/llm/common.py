"""What the training-data operators share: tables, shared scratch, text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweave.storage import Scratch, broadcast_if_small, hot_join, shared_dir, table

__all__ = ["CHUNK_BYTES", "Scratch", "broadcast_if_small", "chunks", "hot_join", "lower_ascii", "shared_dir", "table", "text_bytes", "text_hash"]

#: Text bytes handled at once by the Python stages, so that memory stays bounded whatever a batch holds.
CHUNK_BYTES = 1 << 20


#: The ASCII capitals and what they become.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def text_hash(text: Column) -> Column:
    """Tells the texts of one doc_id apart; null is a text of its own."""
    return F.xxhash64(text.cast("string"))


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes from the column ``text``: (first row, texts)."""
    held: list[bytes] = []
    first = size = 0
    column = batch.column(batch.schema.get_field_index("text"))
    for i in range(batch.num_rows):
        held.append(text_bytes(column[i].as_py()))
        size += len(held[-1])
        if size >= limit:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held
