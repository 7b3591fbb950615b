"""Gates with three values, scores, statuses, triage and multi-source scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A comparison that is null where the observation is: ``kind`` is min, max or above."""

    name: str
    column: str
    kind: str
    threshold: float
    severity: str = "block"


#: Thresholds of the active policy.
GATES = [
    Gate("volume", "doc_count", "min", 5),
    Gate("organisations", "independent_orgs", "min", 3),
    Gate("concentration", "single_org_share", "max", 0.80),
    Gate("prevalence", "maturity_percentile", "max", 80),
    Gate("novelty", "novelty_percentile", "min", 65),
    Gate("persistence", "windows_present", "min", 2),
    Gate("consecutive", "consecutive_windows", "min", 2),
    Gate("teams", "independent_teams", "min", 2),
    Gate("momentum", "momentum_percentile", "min", 65),
    Gate("share_slope", "share_slope", "above", 0),
    Gate("share_change", "share_change", "above", 0),
    Gate("coverage", "coverage_comparable", "min", 1),
    Gate("embedding_coverage", "embedding_coverage", "min", 0.90),
    Gate("coherence", "coherence", "min", 0.50),
    Gate("coherence_calibration", "coherence_calibrated", "min", 1),
    Gate("age", "age_years", "max", 8, "warn"),
    Gate("primary_sources", "primary_sources", "min", 2),
]
#: Weights of the emergence score and of the evidence confidence; confidence a forming topic needs.
WEIGHTS = {"novelty": 0.25, "momentum": 0.25, "persistence": 0.20, "diffusion": 0.20, "coherence": 0.10}
CONFIDENCE = {"completeness": 0.34, "identity": 0.33, "confirmation": 0.33}
MIN_CONFIDENCE = 55.0


def passed(gate: Gate, observed: Column) -> Column:
    return {"min": observed >= gate.threshold, "max": observed <= gate.threshold, "above": observed > gate.threshold}[gate.kind]


def low_prevalence(share: Column, percentile: Column, floor: float, limit: float) -> Column:
    """A known low share or a known low rank passes; both known and high fails; else unknown: SQL's own OR."""
    return (share < floor) | (percentile <= limit)


def gate_vector(columns: list[str], gates: list[Gate] = GATES, prevalence_floor: float | None = None) -> Column:
    """array<struct<gate, severity, passed>>; a metric that the table lacks is unknown."""
    out = []
    for g in gates:
        seen = F.col(g.column).cast("double") if g.column in columns else F.lit(None).cast("double")
        ok = passed(g, seen)
        if g.name == "prevalence" and prevalence_floor is not None:
            ok = low_prevalence(F.col("publication_share") if "publication_share" in columns else F.lit(None).cast("double"), seen, prevalence_floor, g.threshold)
        out.append(F.struct(F.lit(g.name).alias("gate"), F.lit(g.severity).alias("severity"), ok.alias("passed")))
    return F.array(*out)


def failures(gates: Column, state: bool | None) -> Column:
    """Names of blocking gates that failed (False) or are unknown (None)."""
    test = (lambda g: g["passed"].isNull()) if state is None else (lambda g: g["passed"] == F.lit(state))
    return F.transform(F.filter(gates, lambda g: (g["severity"] == "block") & F.coalesce(test(g), F.lit(False))), lambda g: g["gate"])


def emergence_score(weights: dict[str, float] = WEIGHTS, penalty: Column | None = None) -> Column:
    """Weighted sum less penalties within 0 and 1, times 100; null if any part is."""
    raw = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) - (penalty if penalty is not None else F.lit(0.0))
    known = F.lit(True)
    for k in weights:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 100, 2))


def evidence_confidence(weights: dict[str, float] = CONFIDENCE) -> Column:
    """As the score, but an unknown part counts 0 and weights stay."""
    raw = sum((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 100, 2)


def assess(metrics: DataFrame, gates: list[Gate] = GATES, prevalence_floor: float | None = None, penalty: Column | None = None) -> DataFrame:
    """``metrics`` with gates, failed, unknown, status, emergence_score and evidence_confidence.

    widespread dominates; any failed block is candidate; any unknown is watch;
    low confidence or a missing part demotes forming to watch; only forming has a score.
    """
    t = metrics.withColumn("gates", gate_vector(metrics.columns, gates, prevalence_floor))
    t = t.withColumns({"failed": failures(F.col("gates"), False), "unknown": failures(F.col("gates"), None), "evidence_confidence": evidence_confidence(), "_score": emergence_score(penalty=penalty)})
    ready = F.col("_score").isNotNull() & (F.col("evidence_confidence") >= MIN_CONFIDENCE)
    status = F.when(F.array_contains("failed", "prevalence"), "widespread").when(F.size("failed") > 0, "candidate").when((F.size("unknown") > 0) | ~ready, "watch").otherwise("forming")
    return t.withColumn("status", status).withColumn("emergence_score", F.when(F.col("status") == "forming", F.col("_score"))).drop("_score")


#: The gates that speak for a signal itself.
CORE = ["novelty", "momentum", "share_slope", "share_change", "persistence", "consecutive", "coherence"]


def screening(failed: Column, slope: Column, comparable: Column) -> Column:
    """growth_not_confirmed, mixed_evidence, growth_observed or insufficient_data."""
    sure = F.coalesce(comparable, F.lit(False))
    return F.when(sure & (slope <= 0), "growth_not_confirmed").when(F.size(failed) > 0, "mixed_evidence").when(sure & (slope > 0), "growth_observed").otherwise("insufficient_data")


def review_band(failed: Column, unknown: Column, core: Column) -> Column:
    return F.when(F.size(failed) == 0, "verify_missing_evidence").when((core >= 4) & (F.size(failed) <= 2), "monitor_early_acceleration").when(F.size(unknown) > 0, "resolve_and_recheck").otherwise("lower_priority_recheck")


def triage(assessed: DataFrame, label: str, key: str, limit: int = 15) -> DataFrame:
    """The review queue: not widespread, in nine-part order; ``rank`` from 1.

    The limit is the feature, so the order is one bounded sort; only its rows get ranks.
    """
    core = F.size(F.filter("gates", lambda g: g["gate"].isin(CORE) & F.coalesce(g["passed"], F.lit(False))))
    state = screening(F.col("failed"), F.col("share_slope"), F.col("coverage_comparable"))
    joint = F.when(F.col("novelty_percentile").isNotNull() & F.col("momentum_percentile").isNotNull(), F.least("novelty_percentile", "momentum_percentile"))
    t = assessed.where("status <> 'widespread'").withColumns({"core": core, "screening": state, "joint": joint})
    t = t.withColumn("band", review_band(F.col("failed"), F.col("unknown"), F.col("core")))
    first = F.when(F.col("screening") == "growth_observed", 0).when(F.col("screening") == "insufficient_data", 1).when(F.col("screening") == "mixed_evidence", 2).otherwise(4)
    order = [first, F.size("failed"), -F.col("core"), F.size("unknown"), -F.coalesce("joint", F.lit(-1.0)), -F.coalesce("evidence_confidence", F.lit(0.0)), F.lower(label), F.col(key)]
    from pyspark.sql import Window as W

    top = t.withColumn("_o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).orderBy("_o").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy("_o"))).drop("_o")


#: Weights of the science axis; caps of the external bonuses.
SCIENCE = {"growth": 0.40, "novelty": 0.25, "diffusion": 0.15, "persistence": 0.10, "coherence": 0.10}
CAPS = {"news": 10.0, "funding": 10.0, "patents": 5.0}


def science_axis(weights: dict[str, float] = SCIENCE) -> tuple[Column, Column, Column]:
    """(sum over known parts, known weight, upper bound if the unknown were full)."""
    zero = F.lit(0.0)
    base = sum((F.coalesce(F.col(k) * w, zero) for k, w in weights.items()), zero)
    known = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(zero) for k, w in weights.items()), zero)
    return base, known, base + (1 - known) * 100


def external_axis(volume: Column, publishers: Column, fresh: Column) -> Column:
    """0 to 100: up to 60 for volume, 20 for publishers and 20 for recency, each saturating."""
    return 60 * F.least(F.lit(1.0), volume / 4) + 20 * F.least(F.lit(1.0), publishers / 3) + 20 * F.least(F.lit(1.0), fresh / 4)


def patent_axis(volume: Column, applicants: Column) -> Column:
    """0 to 100: up to 70 for families and 30 for applicants."""
    return 70 * F.least(F.lit(1.0), volume / 4) + 30 * F.least(F.lit(1.0), applicants / 3)


def capped_bonus(base: Column, bonuses: list[Column]) -> Column:
    """Base and bonuses, which one factor scales so that the total is 100 at most."""
    total = sum(bonuses, F.lit(0.0))
    return base + F.when(total > 0, total * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 100 - base) / total)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Confirmation:
    """Independence of confirmation by two sources."""

    cap: float = 0.45
    base: float = 0.20
    step: float = 0.05
    fields: tuple[str, ...] = field(default=("dual", "total"))


def confirmation_independence(dual: Column, total: Column, comparable: Column, c: Confirmation = Confirmation()) -> Column:
    """Share of dual confirmations, or a low capped value where sources are not comparable."""
    return F.when(comparable & (total > 0), F.least(F.lit(1.0), dual / total)).otherwise(F.least(F.lit(c.cap), c.base + c.step * dual))
