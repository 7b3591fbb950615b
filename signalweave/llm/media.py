"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, as NPY tiles with difference hashes."""

from __future__ import annotations

import functools
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes

#: Payloads are padded to a positive multiple of this many samples: 24 x 24 grey or 24 x 8 colour.
UNIT, WIDTH, PAD = 576, 24, b"\xff"


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Grey (h, w) as P5, colour (h, w, 3) as P6, 8 bits a sample."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Colour (h, w, 3) as an uncompressed 24-bit bottom-up BMP."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of samples; bitmaps give 0 for black and 1 for white."""
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _FIELD.match(data, at)):
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: height * width] - 48
        return (1 - bits).reshape(shape)
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :width]
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: int(np.prod(shape))], np.int64)
        return values.astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    if kind not in (b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    return np.frombuffer(data, np.uint8 if most < 256 else ">u2", int(np.prod(shape)), at + 1).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (h, w, 3); either row order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packed} is not supported")
    flip, height = height > 0, abs(height)
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows[::-1] if flip else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return colours[rows[:, :width], 2::-1]
    return rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma as doubles; grey images as they are."""
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


@functools.lru_cache(4096)
def _edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.linspace(0, n, cells + 1)
    low = np.minimum(edge.astype(int), n - 1)
    return low, edge - low


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left of each grid point, for the last two axes."""
    whole = np.zeros((*image.shape[:-2], image.shape[-2] + 1, image.shape[-1] + 1))
    np.cumsum(image, axis=-2, out=whole[..., 1:, 1:])
    np.cumsum(whole[..., 1:, 1:], axis=-1, out=whole[..., 1:, 1:])
    return whole


def area_means(whole: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact, fractional source area, from an integral image."""
    h, w = whole.shape[-2] - 1, whole.shape[-1] - 1
    (y, fy), (x, fx) = _edges(h, height), _edges(w, width)
    rows = whole[..., y, :] * (1 - fy)[:, None] + whole[..., y + 1, :] * fy[:, None]
    corner = rows[..., x] * (1 - fx) + rows[..., x + 1] * fx
    bands = corner[..., 1:, :] - corner[..., :-1, :]
    return (bands[..., 1:] - bands[..., :-1]) / (h / height * w / width)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_means(integral(image), height, width)


def _bits(means: np.ndarray) -> list[str]:
    small = np.round(means, 6)
    packed = np.packbits((small[..., :-1] < small[..., 1:]).reshape(-1, 64), axis=1)
    return [row.tobytes().hex() for row in packed]


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 area means under its right neighbour? Sixteen hex digits."""
    return _bits(area_resize(image, 8, 9))[0]


@functools.lru_cache(64)
def _npy_head(side: int) -> bytes:
    np.save(held := io.BytesIO(), np.zeros((side, side), np.uint8), allow_pickle=False)
    return held.getvalue()[: -side * side]


def features(pixels: np.ndarray, side: int = 32, tile: int = 16) -> tuple[str, list[dict]]:
    """The image's difference hash, and its tiles: resized to ``side`` squared and cut, each as NPY bytes with its own hash."""
    whole = integral(grey(pixels))
    n = side // tile
    small = np.clip(np.rint(area_means(whole, side, side)), 0, 255).astype(np.uint8)
    parts = np.ascontiguousarray(small.reshape(n, tile, n, tile).swapaxes(1, 2)).reshape(-1, tile, tile)
    hashes = _bits(area_resize(parts, 8, 9))
    return _bits(area_means(whole, 8, 9))[0], [{"row": i // n, "col": i % n, "npy": _npy_head(tile) + parts[i].tobytes(), "dhash": hashes[i]} for i in range(n * n)]


TILES = "array<struct<row:int,col:int,npy:binary,dhash:string>>"
_TILES = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())]))


def media_tiles(images: DataFrame, column: str = "media", side: int = 32, tile: int = 16) -> DataFrame:
    """``images`` with height, width, dhash and tiles for the encoded images in ``column``.

    Null or undecodable images keep their row with nulls. Columns of these names
    in the input are replaced.
    """
    kept = images.drop("height", "width", "dhash", "tiles")
    schema = kept.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for value in batch.column(batch.schema.get_field_index(column)):
                try:
                    pixels = decode(value.as_py())
                    got.append((pixels.shape[0], pixels.shape[1], *features(pixels, side, tile)))
                except (TypeError, ValueError, struct.error):
                    got.append((None, None, None, None))
            h, w, d, t = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(d, pa.string()), pa.array(t, _TILES)], names=[*batch.schema.names, "height", "width", "dhash", "tiles"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return kept.mapInArrow(read, f"{fields}, height int, width int, dhash string, tiles {TILES}")


def store(payload: bytes) -> bytes:
    """A padded payload as an image; the number of units in it chooses PGM, PPM or BMP."""
    samples = np.frombuffer(payload, np.uint8)
    kind = len(payload) // UNIT % 3
    if kind == 1:
        return encode_netpbm(samples.reshape(-1, WIDTH))
    return (encode_bmp if kind else encode_netpbm)(samples.reshape(-1, WIDTH, 3))


def media_payloads(docs: DataFrame) -> DataFrame:
    """Each text stored losslessly as an image, read back, with its features.

    One row a document: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (difference hash of the
    image, then the CRC of its NPY tiles), n_tiles. A null or empty text is one
    unit of padding. Values depend on the text alone. Map-only, one text at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = text_bytes(value.as_py())
                media = store(raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)))
                pixels = decode(media)
                back = np.ascontiguousarray(pixels).tobytes()
                dhash, tiles = features(pixels)
                crc = 0
                for t in tiles:
                    crc = zlib.crc32(t["npy"], crc)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{dhash}-{crc:08x}", len(tiles)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (2, 5, 6) else pa.int64()) for i, c in enumerate(cols))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_payloads(table(spark, sf_dir, "documents"))
