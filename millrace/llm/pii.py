"""PII replaced by surrogates.

Entities (e-mail addresses, telephone, card, account and social security numbers, IP addresses, keys
and tokens, persons after a form of address) are found by one pattern over each whole text. Each gets a
surrogate drawn from a keyed digest of its normal form, so one entity has one surrogate wherever and
however it is written (coreference). Surrogates keep type and format: digits stay digits, letters stay
letters of their case and script, separators stay, and so do the public prefixes of keys and the country
codes of telephone and account numbers; card numbers that pass the Luhn test still pass it, account
numbers have valid check digits; octets stay octets; given names follow the gender of the form of
address, and names keep their script, capitals, hyphens, particles and prefixes like O'. A form that tells
no gender takes the one that most documents give the name, male if they are as many.

Names are replaced piece by piece (hyphens divide), and where a piece of a name that a form of address
marks stands again in the same text, capitalised and by itself, it gets the same surrogate there.

Distinctness is checked, not hoped for: the different entities of the corpus are brought together
with their surrogates, and those that share one, or whose surrogate is some entity's real value, draw
again until none is left; given names and surnames are one kind in this, whatever their case. Only a
format with fewer values than the corpus uses of it still shares some after ``MOST_DRAWS`` draws. Draws
after the first reach the few documents concerned by a join; the rest is replaced where it stands,
without a shuffle of texts.

Everything is DataFrame expressions. Defined results: null texts stay null with no entities; empty texts
stay empty; null or repeated ids are fine, rows are told apart by id and text; overlapping matches are
taken from the left, the first kind of :data:`KINDS` first; a very long text is searched whole, in its
own row; ``n_entities`` counts what the pattern finds, not a name's bare repeats; other columns are not
read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialised

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Forms of address with the gender they tell.
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа")
_MALE = ("Mr", "Herr", "Señor", "Monsieur", "господин")
_NEUTRAL = ("Dr", "Prof")
_ADDRESS = r"(?<![\p{L}\d])(?:" + "|".join(_FEMALE + _MALE + _NEUTRAL) + r")\.?[ \u00a0\n]"
# Particles of names, which stay.
_PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "bin", "al", "el", "ter", "ten")
_PARTICLE = "(?:(?:" + "|".join(_PARTICLES) + ") ){0,3}"
_PIECE = r"[\p{L}\p{M}]*+"
#: A token of a name: an initial, or capitalised pieces joined by hyphens or apostrophes; a possessive 's is no part of it.
_NAME = rf"(?:\p{{Lu}}\.(?= \p{{Lu}})|[\p{{Lu}}\p{{Lt}}\p{{Lo}}]{_PIECE}(?:['’-](?!s(?![\p{{L}}\p{{M}}]))\p{{L}}{_PIECE})*+)"
#: Kinds of entities and their patterns. None can start within a run of its own characters, so a scan is linear.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "person": _ADDRESS + _PARTICLE + _NAME + rf"(?: {_PARTICLE}{_NAME}){{0,2}}",
}
#: What a person's name is made of.
_ATOMS = r"\p{Lu}\.(?= )|(?<![\p{L}\p{M}])\p{L}{1,2}['’](?=\p{L})|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[ -]"
#: What each kind can begin with; tried before its pattern, and only where no letter or digit stands before.
_STARTS = {"email": "[A-Za-z0-9._%+-]", "ip": r"\d", "secret": "[0-9a-fA-Fgs]", "iban": r"[A-Z][A-Z]\d", "ssn": r"\d", "card": r"\d", "phone": r"[+(\d]", "person": "[" + "".join(sorted({a[0] for a in _FEMALE + _MALE + _NEUTRAL})) + "]"}
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?={_STARTS[k]})(?:{p})" for k, p in KINDS.items()) + ")"

# Parts of made-up names by script: its class, syllables at first, onsets, vowels, ends, and what a woman's name ends in.
_SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", 2, "бвгджзклмнпрстфх", "аеиоу", "нрстлдкм", "а"),
    "greek": (r"\p{IsGreek}", 2, "βγδζθκλμνπρστφχ", "αεηιουω", "ςνρ", "α"),
    "hebrew": (r"\p{IsHebrew}", 2, "בגדהזחטכלמנספקרשת", "אוי", "דרלבת", "ה"),
    "arabic": (r"\p{IsArabic}", 2, "بتجحدرزسشفقكلمنه", "اوي", "درنمل", "ة"),
    "devanagari": (r"\p{IsDevanagari}", 2, "कगचजटडतदनपबमरलसह", "ािीुेो", "नरलम", "ा"),
    "katakana": (r"\p{IsKatakana}", 1, "カサタナハマヤラ", "イキシチニミリ", "コトロン", "コ"),
    "hangul": (r"\p{IsHangul}", 1, "강김박서이정조최", "경석수영우은준철", "호진민", "희"),
    "han": (r"\p{IsHan}", 1, "文明国华军平安天海林山春", "子成德光宏建立志", "生石田川", "花"),
    "latin": ("", 2, "bcdfghjklmnprstv", "aeiou", "nrstldkm", "a"),
}
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Public prefixes of keys, and country codes of one and two digits; the others have three.
_PREFIX = "^(?:AKIA|ghp_|sk-)"
_COUNTRY = r"^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Parts for each task that draws surrogates.
PARTS_TOGETHER = 2000
MOST_DRAWS = 50


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _chars(n: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of 1 .. n, joined."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), f), "")).otherwise(F.lit(""))


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i``, from 0, of a digest of 64 in hex."""
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(symbols: str | list[str], n: Column) -> Column:
    return F.substring(F.lit("".join(symbols)), (n % len(symbols) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test; a number is valid if it ends in 0."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, b: a + b)


def _redrawn(norm: Column, digest: Column, hexed: Column | bool = False, fixed: Column | int = 0) -> Column:
    """Characters replaced by others of their class; the first ``fixed`` stay."""

    def one(i: Column) -> Column:
        c, r = F.substring(norm, i, F.lit(1)), _byte(digest, i)
        wide = F.lit(hexed) if isinstance(hexed, bool) else hexed
        return (
            F.when(i <= fixed, c).when(c.between("0", "9"), _pick(_DIGITS, r)).when(c.between("a", "z"), F.when(wide, _pick(_LOWER[:6], r)).otherwise(_pick(_LOWER, r)))
            .when(c.between("A", "Z"), F.when(wide, _pick(_UPPER[:6], r)).otherwise(_pick(_UPPER, r))).otherwise(c)
        )

    return _chars(F.length(norm), one)


def _name(norm: Column, digest: Column, draw: Column, female: Column) -> Column:
    """A made-up name of the same script; later draws are longer, so names never run out."""

    def values(script: str) -> Column:
        _, first, onsets, vowels, ends, woman = _SCRIPTS[script]
        return F.struct(F.lit(first).alias("first"), F.lit(onsets).alias("onsets"), F.lit(vowels).alias("vowels"), F.lit(ends).alias("ends"), F.lit(woman).alias("woman"))

    def pick(symbols: Column, n: Column) -> Column:
        return F.substring(symbols, (n % F.length(symbols) + 1).cast("int"), F.lit(1))

    def made(s: Column) -> Column:
        n = s["first"] + F.floor(draw / 3).cast("int")
        stem = _chars(n, lambda i: F.concat(pick(s["onsets"], _byte(digest, 2 * i)), pick(s["vowels"], _byte(digest, 2 * i + 1))))
        return F.initcap(F.concat(stem, pick(s["ends"], _byte(digest, F.lit(50))), F.when(female, s["woman"]).otherwise("")))

    other = [s for s in _SCRIPTS if s != "latin"]
    chosen = F.when(F.regexp_like(norm, F.lit(_SCRIPTS[other[0]][0])), values(other[0]))
    chosen = reduce(lambda c, s: c.when(F.regexp_like(norm, F.lit(_SCRIPTS[s][0])), values(s)), other[1:], chosen).otherwise(values("latin"))
    return _let(chosen, made)


def _check_digits(iban: Column) -> Column:
    """The two check digits of an account number, whatever stands in their place."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(2)), F.lit("00"))

    def step(rest: Column, c: Column) -> Column:
        digit = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _stays(atom: Column) -> Column:
    """What of a name is no piece with a surrogate: separators, particles, prefixes like O', initials (these are shifted)."""
    return atom.isin(" ", "-", *_PARTICLES) | F.regexp_like(atom, F.lit(r"^(?:\p{Lu}\.|\p{L}{1,2}['’])$"))


def _items(entity: Column) -> Column:
    """``text, part`` of what an entity is made of, in order: a part, as ``kind:normal form``, gets a surrogate of its own; null stays."""
    address = F.regexp_extract(entity, "^" + _ADDRESS, 0)
    form = F.regexp_extract(entity, r"^\p{L}+", 0)
    given = F.when(form.isin(*_FEMALE), "given_f:").when(form.isin(*_MALE), "given_m:").otherwise("given_n:")
    atoms = F.regexp_extract_all(F.substring(entity, F.length(address) + 1, F.length(entity)), F.lit(_ATOMS), F.lit(0))
    item = lambda text, part: F.struct(text.alias("text"), part.alias("part"))

    def pieces(all: Column) -> Column:
        after = F.array_position(F.reverse(all), " ")  # pieces after the last space are the surname's
        of = lambda x, i: item(x, F.when(~_stays(x), F.concat(F.when((after > 0) & (i < F.size(all) - after), given).otherwise("surname:"), F.lower(x))))
        return F.concat(F.array(item(address, F.lit(None).cast("string"))), F.transform(all, of))

    digits = F.regexp_replace(entity, r"\D", "")
    phone = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits)
    whole = {"email": F.lower(entity), "ip": entity, "secret": entity, "iban": F.regexp_replace(entity, " ", ""), "ssn": digits, "card": digits, "phone": phone}
    kind = reduce(lambda c, k: c.when(_is(entity, k), F.concat(F.lit(f"{k}:"), whole[k])), list(whole)[1:], F.when(_is(entity, "email"), F.concat(F.lit("email:"), whole["email"])))
    return F.when(_is(entity, "person"), _let(atoms, pieces)).otherwise(F.array(item(entity, kind)))


def parts(entity: Column) -> Column:
    """What of an entity gets a surrogate of its own, as ``kind:normal form``."""
    return F.filter(F.transform(_items(entity), lambda x: x["part"]), lambda p: p.isNotNull())


def _is(entity: Column, kind: str) -> Column:
    return F.regexp_like(entity, F.lit(f"^(?:{KINDS[kind]})$"))


def surrogate(part: Column, draw: Column, key: str) -> Column:
    """The ``draw``-th surrogate of a part's normal form."""

    def made(x: Column) -> Column:
        kind, norm, d, draw = x["kind"], x["norm"], x["digest"], x["draw"]
        local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        more = _chars(F.floor(draw / 8).cast("int"), lambda i: _pick(_LOWER, _byte(d, i + 40)))  # short names would run out

        def card(c: Column) -> Column:
            body = F.substring(c, F.lit(1), F.length(c) - 1)
            check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
            return F.when(_luhn(norm) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(c)

        hexed = (kind == "secret") & F.regexp_like(norm, F.lit("^[0-9a-fA-F]+$"))
        fixed = F.when(kind == "secret", F.length(F.regexp_extract(norm, _PREFIX, 0))).when(kind == "phone", F.greatest(F.length(F.regexp_extract(norm, _COUNTRY, 0)), F.lit(1)))
        fixed = fixed.when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
        alike = _redrawn(F.when(kind == "email", local).otherwise(norm), d, hexed, fixed)
        address = lambda drawn: F.concat(drawn, more, F.lit("@"), _redrawn(host, F.sha2(F.concat(F.lit(f"{key}|host|"), domain), 512)), top)
        account = lambda drawn: F.concat(F.substring(drawn, F.lit(1), F.lit(2)), _check_digits(drawn), F.substring(drawn, F.lit(5), F.length(drawn)))
        octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(d, i) % 254 + 1).cast("string")), ".")
        by_kind = lambda drawn: F.when(kind == "email", address(drawn)).when(kind == "card", card(drawn)).when(kind == "iban", account(drawn)).otherwise(drawn)
        names = kind.startswith("given") | (kind == "surname")
        return F.when(names, _name(norm, d, draw, kind == "given_f")).when(kind == "ip", octets).otherwise(_let(alike, by_kind))

    def taken(p: Column) -> Column:
        kind = F.substring_index(p, ":", 1)
        digest = F.sha2(F.concat(F.lit(f"{key}|"), draw.cast("string"), F.lit("|"), p), 512)
        return F.struct(kind.alias("kind"), F.substring(p, F.length(kind) + 2, F.length(p)).alias("norm"), digest.alias("digest"), draw.alias("draw"))

    return _let(part, lambda p: _let(taken(p), made))


def _overlay(entity: Column, drawn: Column) -> Column:
    """The characters of ``drawn`` in the places that letters and digits have in ``entity``."""

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^A-Za-z0-9]", ""))
        return F.when(F.regexp_like(c, F.lit("[A-Za-z0-9]")), F.substring(drawn, place, F.lit(1))).otherwise(c)

    return _chars(F.length(entity), one)


def _drawn_as(part: Column) -> Column:
    """The part whose surrogate a part gets if the corpus says nothing else: names without a gender go as male."""
    return F.regexp_replace(part, "^given_n:", "given_m:")


def _drawn_as(part: Column) -> Column:
    """The part whose surrogate a part gets if the corpus says nothing else: names without a gender go as male."""
    return F.regexp_replace(part, "^given_n:", "given_m:")


def _drawn(part: Column, draws: Column, key: str) -> Column:
    """The surrogate of a part. ``draws``: a map of parts to ``drawn_as, draw`` where these aren't the usual ones, or null."""

    def found(p: Column) -> Column:
        return _let(F.element_at(draws, p), lambda x: F.struct(F.coalesce(x["drawn_as"], _drawn_as(p)).alias("part"), F.coalesce(x["draw"], F.lit(0)).alias("draw")))

    return _let(_let(part, found), lambda x: surrogate(x["part"], x["draw"], key))


def _styled(name: Column, like: Column) -> Column:
    return _let(name, lambda n: F.when((F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like)), F.upper(n)).otherwise(n))


def replaced(entity: Column, draws: Column, key: str) -> Column:
    """``part, made, out`` of what an entity is made of: the surrogates as drawn, and what stands for the entity's text. An initial moves on by a number of letters that depends on the key."""
    step = F.conv(F.substring(F.md5(F.lit(f"{key}|initial")), 1, 4), 16, 10).cast("int") % 25 + 1
    shifted = F.substring(F.lit(_UPPER + _UPPER), step + 1, F.lit(26))

    def kept(text: Column) -> Column:
        moved = F.coalesce(F.substring(shifted, F.nullif(F.instr(F.lit(_UPPER), F.substring(text, 1, 1)), F.lit(0)), F.lit(1)), F.lit("X"))
        return F.when(F.regexp_like(text, F.lit(r"^\p{Lu}\.$")), F.concat(moved, F.lit("."))).otherwise(text)

    def one(x: Column) -> Column:
        text, part = x["text"], x["part"]
        out = lambda d: F.when(_is_name(part), _styled(d, text)).when(F.regexp_like(part, F.lit("^(?:email|ip|secret):")), d).otherwise(_overlay(text, F.regexp_replace(d, "^[+]", "")))
        return _let(F.when(part.isNotNull(), _drawn(part, draws, key)), lambda d: F.struct(part.alias("part"), d.alias("made"), F.when(d.isNull(), kept(text)).otherwise(out(d)).alias("out")))

    return F.transform(_items(entity), one)


def _names(items: Column) -> Column:
    """``name, made`` of the different pieces of names in a text, a surname before a given name that is alike."""
    names = F.filter(F.flatten(items), lambda x: F.coalesce(_is_name(x["part"]), F.lit(False)))
    found = F.array_sort(F.array_distinct(F.transform(names, lambda x: F.struct(F.substring_index(x["part"], ":", -1).alias("name"), F.when(x["part"].startswith("surname"), 0).otherwise(1).alias("k"), x["made"].alias("made")))))
    return _let(found, lambda all: F.filter(all, lambda x, i: (i == 0) | (F.get(all, i - 1)["name"] != x["name"])))


def _is_name(part: Column) -> Column:
    return F.regexp_like(part, F.lit("^(?:given_.|surname):"))


def _repeats(segment: Column, names: Column) -> Column:
    """Text between entities, with its capitalised words that are names replaced."""
    words = F.regexp_extract_all(segment, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))

    def one(word: Column) -> Column:
        hit = _let(F.lower(word), lambda w: F.get(F.filter(names, lambda n: n["name"] == w), 0))
        return F.when((F.length(word) > 1) & F.regexp_like(word, F.lit(r"^[\p{Lu}\p{Lt}\p{Lo}]")), _let(hit, lambda n: F.coalesce(_styled(n["made"], word), word))).otherwise(word)

    return F.array_join(F.transform(words, one), "")


def _compared(part: Column) -> Column:
    """A part in the form in which parts and surrogates are told apart: all names are one kind, in lower case."""
    return F.when(_is_name(part), F.concat(F.lit("name:"), F.lower(F.substring_index(part, ":", -1)))).otherwise(part)


def parts_drawn_as(seen: DataFrame) -> DataFrame:
    """``part, drawn_as`` for the different parts of ``seen``: given names after a form without a gender get the one that most documents tell."""
    name = F.substring_index("part", ":", -1)
    told = seen.where(F.col("part").startswith("given_")).groupBy(name.alias("name")).agg(*[F.count_if(F.col("part").startswith(f"given_{g}:")).alias(g) for g in "fmn"])
    women = told.where("f > m and n > 0").select(F.concat(F.lit("given_n:"), "name").alias("part"), F.concat(F.lit("given_f:"), "name").alias("woman"))
    return seen.select("part").distinct().join(women, "part", "left").select("part", F.coalesce("woman", _drawn_as(F.col("part"))).alias("drawn_as"))


def draws_needed(occurrences: DataFrame, key: str) -> DataFrame:
    """``part, draw`` for parts whose first surrogate was someone else's too. ``occurrences``: column ``part``."""
    table = materialised(occurrences.select("part").distinct(), "parts")
    tasks = max(1, min(math.ceil(table.count() / PARTS_TOGETHER), 10_000))
    table = materialised(table.repartition(tasks).withColumn("draw", F.lit(0)), "parts")
    for _ in range(MOST_DRAWS):
        made = F.concat(F.substring_index("part", ":", 1), F.lit(":"), surrogate(F.col("part"), F.col("draw"), key))
        drawn = materialised(table.select("part", "draw", _compared(made).alias("made")), "drawn")
        owner = drawn.groupBy("made").agg(F.min("part").alias("owner"), F.count("*").alias("n"))
        real = drawn.select(_compared(F.col("part")).alias("made")).distinct().withColumn("real", F.lit(True))
        clash = owner.join(real, "made", "left").where("n > 1 or real").select("made", "owner", "real")
        again = drawn.join(clash, "made").where(F.col("real") | (F.col("part") != F.col("owner"))).select("part", F.lit(True).alias("again"))
        again = materialised(again, "again")
        if again.isEmpty():
            return table.where("draw > 0")
        table = materialised(table.join(again, "part", "left").select("part", (F.col("draw") + F.coalesce(F.col("again"), F.lit(False)).cast("int")).alias("draw")), "parts")
    return table.where("draw > 0")


def replace(docs: DataFrame, id: str = "doc_id", text: str = "text", key: str = "millrace") -> DataFrame:
    """``id``, ``text`` with surrogates, ``n_entities`` and ``kinds`` for each row. ``key``: the secret that draws depend on."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    rows = rows.withColumn("entities", F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")))
    seen = rows.where(F.size("entities") > 0).select("id", "version", F.explode(F.array_distinct(F.flatten(F.transform("entities", parts)))).alias("part"))
    seen = materialised(seen, "entities")
    known = materialised(parts_drawn_as(seen), "drawn_as")
    again = draws_needed(known.select(F.col("drawn_as").alias("part")), key).withColumnRenamed("part", "drawn_as")
    needed = known.join(again, "drawn_as", "left").where(F.col("draw").isNotNull() | (F.col("drawn_as") != _drawn_as(F.col("part"))))
    needed = materialised(needed.select("part", F.struct("drawn_as", F.coalesce("draw", F.lit(0)).alias("draw")).alias("draw")), "needed")
    if needed.isEmpty():
        rows = rows.withColumn("draws", F.lit(None).cast("map<string,struct<drawn_as:string,draw:int>>"))
    else:
        hits = seen.distinct().join(needed, "part").groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(F.map_from_entries(F.collect_list(F.struct("part", "draw"))).alias("draws"))
        rows = rows.join(hits, rows.id.eqNullSafe(hits["__id"]) & (rows.version == hits["__version"]), "left")
    between = F.split("text", PATTERN, -1)
    shown = lambda items: F.transform(items, lambda x: F.array_join(F.transform(x, lambda y: y["out"]), ""))
    cut = lambda names: F.when(F.size(names) > 0, F.transform(between, lambda x: _repeats(x, names))).otherwise(between)
    join = lambda items: F.array_join(F.zip_with(_let(_names(items), cut), shown(items), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = _let(F.transform("entities", lambda e: replaced(e, F.col("draws"), key)), join)
    kinds = F.array_sort(F.array_distinct(F.transform("entities", _kind)))
    return rows.select(F.col("id").alias(id), F.when(F.size("entities") > 0, new).otherwise(F.col("text")).alias("text"), F.size("entities").cast("long").alias("n_entities"), F.when(F.size("entities") > 0, kinds).otherwise(F.array().cast("array<string>")).alias("kinds"))


def _kind(entity: Column) -> Column:
    names = list(KINDS)
    return reduce(lambda c, k: c.when(_is(entity, k), k), names[1:], F.when(_is(entity, names[0]), names[0])).otherwise("other")


def report(docs: DataFrame) -> DataFrame:
    return replace(docs)
