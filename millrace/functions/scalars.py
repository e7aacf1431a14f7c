"""Scalar helpers: cleaning, strict parsing, rounding, hashing, masking. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def empty_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def money(c: Column, scale: int = 2) -> Column:
    """A decimal from text, comma or dot, rounded half to even; null if it isn't a finite number."""
    wide = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(38,18)")
    return F.bround(wide, scale).cast(f"decimal(12,{scale})")


def instant(c: Column) -> Column:
    """A timestamp from strict ISO text; without a zone it is UTC (the session's zone); null if invalid."""
    return F.when(F.trim(c).rlike(_ISO), F.trim(c).try_cast("timestamp"))


def day(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(c).try_cast("date"))


def cast_failed(raw: Column, kind: str) -> Column:
    """Whether text is there but isn't of the kind."""
    return raw.isNotNull() & raw.try_cast(kind).isNull()


def surrogate_key(*columns: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def content_tag(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def hmac_sha256(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, from the definition: hash(outer pad, hash(inner pad, message))."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.).*(@.*)$", "$1***$2")


def mask_tail(c: Column, keep: int = 4) -> Column:
    return F.concat(F.lit("***"), F.right(c, F.lit(keep)))


def by_role(role: str, clear: Column, masked: Column, allowed: tuple[str, ...] = ("admin",)) -> Column:
    """Dynamic masking: the clear value for allowed roles."""
    return clear if role in allowed else masked


def first_reason(rules: list[tuple[Column, str | Column]]) -> Column:
    """The reason of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(bad, reason if isinstance(reason, Column) else F.lit(reason)) for bad, reason in rules])


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The reasons of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in rules]), lambda x: x.isNotNull())


def json_sorted(*names: str) -> Column:
    return F.to_json(F.struct(*sorted(names)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def cents_to_units(c: Column, scale: int = 2) -> Column:
    return F.round(c.cast("decimal(18,4)") / 100, scale)
