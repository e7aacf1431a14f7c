"""Data contracts: columns, types and checks, themselves validated."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

TYPES = {"VARCHAR": T.StringType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "BOOLEAN": T.BooleanType()}
ROW_CHECKS = {"not_null", "range", "accepted_values", "regex"}
DATASET_CHECKS = {"unique", "row_count_between", "null_rate_max", "freshness", "anomaly_row_count", "anomaly_mean"}
WIDER = {("INTEGER", "BIGINT"), ("INTEGER", "DOUBLE"), ("BIGINT", "DOUBLE"), ("DATE", "TIMESTAMP")}


class ContractError(ValueError):
    """The contract itself is wrong."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "VARCHAR"
    required: bool = True


@dataclass(frozen=True)
class Check:
    id: str
    type: str
    severity: str = "hard"
    column: str | None = None
    columns: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    @property
    def level(self) -> str:
        return "row" if self.type in ROW_CHECKS else "dataset"


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[ColumnSpec, ...]
    checks: tuple[Check, ...] = ()
    allow_extra_columns: bool = False
    max_quarantine_rate: float = 0.05

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type]) for c in self.columns])


def parse(raw: dict) -> Contract:
    """A contract from plain data; every fault is a :class:`ContractError`."""
    if not isinstance(raw, dict) or not raw.get("name") or not raw.get("columns"):
        raise ContractError("a contract needs a name and columns")
    columns = tuple(ColumnSpec(c["name"], str(c.get("type", "VARCHAR")).upper(), bool(c.get("required", True))) for c in raw["columns"])
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise ContractError("a column is named twice")
    for c in columns:
        if c.type not in TYPES:
            raise ContractError(f"{c.name}: unknown type {c.type}")
    checks = []
    for x in raw.get("checks", []):
        kind, severity = x.get("type"), x.get("severity", "hard")
        used = tuple(x.get("columns", ())) or ((x["column"],) if x.get("column") else ())
        if kind not in ROW_CHECKS | DATASET_CHECKS:
            raise ContractError(f"unknown check {kind}")
        if severity not in ("hard", "soft"):
            raise ContractError(f"{kind}: unknown severity {severity}")
        if unknown := [u for u in used if u not in names]:
            raise ContractError(f"{kind}: unknown columns {unknown}")
        if kind in ROW_CHECKS | {"null_rate_max", "freshness", "anomaly_mean"} and len(used) != 1:
            raise ContractError(f"{kind} needs one column")
        options = {k: v for k, v in x.items() if k not in ("id", "type", "severity", "column", "columns")}
        if kind == "null_rate_max" and not 0 <= float(options.get("max", -1)) <= 1:
            raise ContractError("null_rate_max needs a rate from 0 to 1")
        if kind == "regex":
            re.compile(options["pattern"])
        checks.append(Check(x.get("id") or f"{kind}:{','.join(used)}", kind, severity, used[0] if len(used) == 1 else None, used, options))
    if len({c.id for c in checks}) < len(checks):
        raise ContractError("a check id is used twice")
    rate = float(raw.get("max_quarantine_rate", 0.05))
    if not 0 <= rate <= 1:
        raise ContractError("max_quarantine_rate must be from 0 to 1")
    return Contract(raw["name"], columns, tuple(checks), bool(raw.get("allow_extra_columns", False)), rate)


def load(path: str | Path) -> Contract:
    """A contract from a YAML file."""
    import yaml

    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def compatibility(old: Contract, new: Contract) -> dict[str, list[str]]:
    """What breaks readers of old data (``backward``) and old readers of new data (``forward``)."""
    before, after = {c.name: c for c in old.columns}, {c.name: c for c in new.columns}
    backward = [f"new required column {n}" for n, c in after.items() if n not in before and c.required]
    forward = [f"required column {n} is gone" for n, c in before.items() if n not in after and c.required]
    for n in before.keys() & after.keys():
        a, b = before[n].type, after[n].type
        if a != b and (a, b) not in WIDER:
            backward.append(f"{n}: {a} does not read as {b}")
        if a != b and (b, a) not in WIDER:
            forward.append(f"{n}: {b} does not read as {a}")
    return {"backward": sorted(backward), "forward": sorted(forward)}
