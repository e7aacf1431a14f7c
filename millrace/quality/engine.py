"""Checks compiled into one aggregation, the publish gate, and quarantine."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.quality.contract import TYPES, Check, Contract


@dataclass(frozen=True)
class Result:
    id: str
    level: str
    severity: str
    passed: bool
    observed: float | None
    skipped: bool = False


@dataclass
class Outcome:
    status: str
    reasons: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    results: list[Result] = field(default_factory=list)
    rows: int = 0
    quarantined: int = 0
    published: DataFrame | None = None
    quarantine: DataFrame | None = None


def schema_faults(columns: list[str], contract: Contract) -> list[str]:
    known = [c.name for c in contract.columns]
    missing = [f"missing column {c.name}" for c in contract.columns if c.required and c.name not in columns]
    return missing + ([] if contract.allow_extra_columns else [f"unexpected column {c}" for c in columns if c not in known])


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    """All-text rows with typed columns; the text stays beside them in ``__raw``. Missing optional columns are null."""
    text = {c.name: F.nullif(F.trim(F.col(c.name)), F.lit("")) if c.name in raw.columns else F.lit(None).cast("string") for c in contract.columns}
    kinds = {c.name: TYPES[c.type].simpleString() for c in contract.columns}
    cast = [text[n].try_cast(k).alias(n) if k != "string" else text[n].alias(n) for n, k in kinds.items()]
    failed = [(text[n].isNotNull() & text[n].try_cast(k).isNull()).alias(f"__bad_{n}") for n, k in kinds.items() if k != "string"]
    return raw.select(F.struct(*raw.columns).alias("__raw"), *cast, *failed)


def violates(check: Check) -> Column:
    """Whether a row breaks a row check; a null value breaks only ``not_null``."""
    c, o = F.col(check.column), check.options
    if check.type == "not_null":
        return c.isNull()
    if check.type == "range":
        outside = ([c < o["min"]] if o.get("min") is not None else []) + ([c > o["max"]] if o.get("max") is not None else [])
        return F.coalesce(reduce(lambda a, b: a | b, outside, F.lit(False)), F.lit(False))
    if check.type == "accepted_values":
        return c.isNotNull() & ~c.isin(o["values"])
    return F.coalesce(~c.rlike(o["pattern"]), F.lit(False))


def _dataset_value(check: Check, as_of: datetime | None) -> Column:
    if check.type == "unique":
        key = F.col(check.columns[0]) if len(check.columns) == 1 else F.struct(*check.columns)
        return F.count("*") - F.countDistinct(key)
    if check.type in ("row_count_between", "anomaly_row_count"):
        return F.count("*")
    if check.type == "null_rate_max":
        return F.coalesce(F.avg(F.col(check.column).isNull().cast("double")), F.lit(0.0))
    if check.type == "freshness":
        return (F.lit(as_of or datetime.utcnow()).cast("timestamp").cast("double") - F.max(F.col(check.column).cast("timestamp")).cast("double")) / 3600
    return F.avg(check.column)


def robust_z(value: float, history: list[float], floor_share: float = 0.01) -> float:
    """0.6745 (x - median) / max(MAD, a share of the median, 1e-9)."""
    mid = median(history)
    mad = median(abs(x - mid) for x in history)
    return 0.6745 * (value - mid) / max(mad, floor_share * abs(mid), 1e-9)


def robust_z_strict(value: float, history: list[float], least: int = 3) -> float | None:
    """(x - median) / (1.4826 MAD); 0 for the same value as a constant history, None for another or for too little history."""
    if len(history) < least:
        return None
    mid = median(history)
    mad = median(abs(x - mid) for x in history)
    if mad == 0:
        return 0.0 if value == mid else None
    return (value - mid) / (1.4826 * mad)


def robust_scores(df: DataFrame, value: str, floor_share: float = 0.01) -> DataFrame:
    """Both robust scores of each row against the whole column: ``score`` with a floor under the MAD, ``strict`` without (null where the MAD is 0 and the value differs)."""
    c = F.col(value).cast("double")
    mid = df.agg(F.percentile(c, 0.5).alias("__mid"))
    mad = df.join(F.broadcast(mid)).agg(F.first("__mid").alias("__mid"), F.percentile(F.abs(c - F.col("__mid")), 0.5).alias("__mad"))
    off = c - F.col("__mid")
    score = 0.6745 * off / F.greatest("__mad", F.lit(floor_share) * F.abs("__mid"), F.lit(1e-9))
    strict = F.when(F.col("__mad") > 0, off / (1.4826 * F.col("__mad"))).when(off == 0, F.lit(0.0))
    return df.join(F.broadcast(mad)).withColumns({"score": score, "strict": strict}).drop("__mid", "__mad")


def _judge(check: Check, value, history: dict[str, list[float]]) -> Result:
    o, skipped = check.options, False
    if check.type == "unique":
        ok = value == 0
    elif check.type == "row_count_between":
        ok = o.get("min", 0) <= value <= o.get("max", math.inf)
    elif check.type == "null_rate_max":
        ok = value <= o["max"]
    elif check.type == "freshness":
        ok = value is not None and value <= o["max_age_hours"]
    else:
        past = history.get(check.id, [])
        skipped = len(past) < o.get("min_history", 5) or value is None
        ok = skipped or abs(robust_z(float(value), past)) <= o.get("z_max", 5)
    return Result(check.id, "dataset", check.severity, bool(ok), None if value is None else float(value), skipped)


def run(raw: DataFrame, contract: Contract, as_of: datetime | None = None, history: dict[str, list[float]] | None = None) -> Outcome:
    """Check an all-text batch. One aggregation answers all checks; the batch is published less its bad rows, or blocked.

    Rows that break a hard row check, or whose text doesn't cast, go to quarantine with the ids of all
    the checks they break. Blocked: a wrong schema, an empty batch, a failed hard dataset check, or too
    large a share of quarantined rows. Failed soft checks warn.
    """
    if faults := schema_faults(raw.columns, contract):
        return Outcome("blocked", faults, results=[Result("schema", "dataset", "hard", False, float(len(faults)))])
    rows = typed(raw, contract)
    casts = [c.name for c in contract.columns if c.type != "VARCHAR"]
    row_checks = [c for c in contract.checks if c.level == "row"]
    data_checks = [c for c in contract.checks if c.level == "dataset"]
    hard = [(f"type_cast:{n}", F.col(f"__bad_{n}")) for n in casts] + [(c.id, violates(c)) for c in row_checks if c.severity == "hard"]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(i)) for i, bad in hard]).cast("array<string>"), lambda x: x.isNotNull())
    marked = rows.withColumn("__reasons", reasons)
    answers = marked.agg(
        F.count("*").alias("n"), F.count(F.when(F.size("__reasons") > 0, 1)).alias("bad"),
        *[F.count(F.when(F.col(f"__bad_{n}"), 1)).alias(f"cast_{n}") for n in casts],
        *[F.count(F.when(violates(c), 1)).alias(f"row_{i}") for i, c in enumerate(row_checks)],
        *[_dataset_value(c, as_of).alias(f"data_{i}") for i, c in enumerate(data_checks)],
    ).first()
    results = [Result("schema", "dataset", "hard", True, 0.0)]
    results += [Result(f"type_cast:{n}", "row", "hard", answers[f"cast_{n}"] == 0, float(answers[f"cast_{n}"])) for n in casts]
    results += [Result(c.id, "row", c.severity, answers[f"row_{i}"] == 0, float(answers[f"row_{i}"])) for i, c in enumerate(row_checks)]
    results += [_judge(c, answers[f"data_{i}"], history or {}) for i, c in enumerate(data_checks)]
    n, bad = answers["n"], answers["bad"]
    blocked = ["empty batch"] if n == 0 else []
    blocked += [f"check {r.id} failed" for r in results if r.level == "dataset" and r.severity == "hard" and not r.passed]
    if n and bad / n > contract.max_quarantine_rate:
        blocked.append(f"quarantine rate {bad / n:.4f} is above {contract.max_quarantine_rate}")
    warnings = [f"check {r.id} failed" for r in results if r.severity == "soft" and not r.passed]
    kept = marked.where(F.size("__reasons") == 0).select(*[c.name for c in contract.columns])
    lost = marked.where(F.size("__reasons") > 0).select("__raw.*", F.col("__reasons").alias("reasons"))
    return Outcome("blocked" if blocked else "published", blocked, warnings, results, n, bad, None if blocked else kept, lost)


def report(outcome: Outcome, name: str) -> dict:
    """The outcome as plain data, for JSON."""
    return {"contract": name, "status": outcome.status, "rows": outcome.rows, "quarantined": outcome.quarantined, "reasons": outcome.reasons, "warnings": outcome.warnings, "checks": [r.__dict__ for r in outcome.results]}


def markdown(outcome: Outcome, name: str) -> str:
    lines = [f"# {name}: {outcome.status}", "", f"{outcome.rows} rows, {outcome.quarantined} quarantined", "", "| check | severity | passed | observed |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r.id} | {r.severity} | {'skipped' if r.skipped else r.passed} | {r.observed} |" for r in outcome.results]) + "\n"


def metrics(outcome: Outcome, name: str) -> str:
    """Prometheus text format; skipped checks are left out."""
    out = ["# TYPE dq_rows gauge", f'dq_rows{{contract="{name}"}} {outcome.rows}', "# TYPE dq_quarantined_rows gauge", f'dq_quarantined_rows{{contract="{name}"}} {outcome.quarantined}', "# TYPE dq_published gauge", f'dq_published{{contract="{name}"}} {int(outcome.status == "published")}', "# TYPE dq_check_passed gauge"]
    out += [f'dq_check_passed{{contract="{name}",check="{r.id}",severity="{r.severity}"}} {int(r.passed)}' for r in outcome.results if not r.skipped]
    return "\n".join(out) + "\n"


def reject_gate(read: int, rejected: int, most: float) -> None:
    """Stop a load whose share of rejected rows is too large."""
    if read and rejected / read > most:
        raise ValueError(f"{rejected} of {read} rows were rejected; the limit is {most:.0%}")


def batch_gate(read: int, rejected: int, duplicates: int, age_hours: float | None, volumes: list[float], most_rejects: float = 0.05, most_age: float = 36, most_duplicates: float = 0.10, z_limit: float = 4) -> dict:
    """The daily gate: hard limits on emptiness, rejects and age; soft ones on duplicates and volume."""
    hard, soft = [], []
    if read == 0:
        hard.append("not_empty")
    if read and rejected / read > most_rejects:
        hard.append("reject_rate")
    if age_hours is None or age_hours > most_age:
        hard.append("freshness")
    if read and duplicates / read > most_duplicates:
        soft.append("duplicate_rate")
    z = robust_z_strict(read, volumes)
    if z is None and len(volumes) >= 3 or z is not None and abs(z) > z_limit:
        soft.append("volume")
    return {"approved": not hard, "hard": hard, "soft": soft, "z": z}
