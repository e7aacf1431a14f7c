"""The pipeline, stage by stage, against brute force on what the stage before it kept."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm import decontaminate, mixture
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_kept, brute_rules


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, data):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, tables = docs, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from millrace.llm.common import materialised

        kept = materialised(stage(spark, kept, data), name)
        assert kept.columns == docs.columns
        tables.append(kept.collect())
    raw, ruled, near, clean, mixed = ({r["doc_id"]: r["text"] for r in t} for t in tables)
    for d, t in raw.items():
        n, _, _, _, repeats = brute_rules(t)
        assert not (d in ruled and (n < 10 or 100 * repeats > 20 * n))
    fps = {d: brute_fingerprint(t) for d, t in ruled.items()}
    label = brute_components(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[label[f]] = min(least.get(label[f], d), d)
    assert set(near) == set(least.values())
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    exact = {d for d, t in near.items() if any(i in decontaminate.normalise(t) for i in items)}
    assert not exact & set(clean) and len(near) - len(clean) <= len(exact) + 2
    times = {d: sum(r["doc_id"] == d for r in tables[4]) for d in clean}
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixture.report(spark.createDataFrame(tables[3], docs.schema)).collect()}
    assert times == want and set(mixed) <= set(clean)
    got = corpus_pipeline.STAGES[-1][1](spark, kept, data).orderBy("start").collect()
    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert len(got) == len(tables[4])
    for r in got:
        ids = np.array([*plain.encode(mixed[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_rows_without_an_id_of_their_own_are_judged_one_by_one(spark):
    item = "which of these rivers runs through the old town and past the mill"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"so {item} then"), (None, "clean one"), (None, "clean two"), (7, f"so {item} then"), (7, "clean three"), (8, None)]
    left = decontaminate.keep(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["text"] or "") for r in left) == ["", "clean one", "clean three", "clean two"]


def test_mix_meets_its_targets_without_ids(spark):
    rows = [(None if i % 2 else i % 10, f"text number {i} of {i % 3 * 'many '}words", "a" if i % 4 else "b") for i in range(300)] + [(None, "the same text again", "c")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source_size"]: (r["target"], r["n"]) for r in mixture.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()}
    sizes = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " +"))).alias("n")).collect()}
    got = {r["source"]: r["n"] for r in mixture.sample(df).groupBy("source").agg(F.sum(F.size(F.split("text", " +"))).alias("n")).collect()}
    for s, n in sizes.items():
        target, drawn = want[n]
        assert got[s] == drawn and abs(drawn - target) <= 10


def plain_pipeline(rows, items):
    """The first three stages and the copies of the fourth, row by row. Rows: id, text, source."""
    kept = [r for r in rows if brute_kept(r[1])]
    fps = [brute_fingerprint(r[1]) for r in kept]
    label = brute_components(set(fps))
    first = {}
    for r, f in zip(kept, fps, strict=True):
        rank = (r[0] is None, r[0] or 0)
        if label[f] not in first or rank < first[label[f]][0]:
            first[label[f]] = rank, r
    ranks = {k: v[0] for k, v in first.items()}
    allowed = {}
    for r, f in zip(kept, fps, strict=True):
        if (r[0] is None, r[0] or 0) == ranks[label[f]]:
            allowed.setdefault(label[f], set()).add((r[0], r[1]))
    leaks = lambda t: any(i in decontaminate.normalise(t) for i in items)
    return kept, allowed, leaks


def test_stages_judge_rows_whatever_their_ids(spark, data, tmp_path):
    """Null, repeated and duplicate ids, and columns with the names that the operators use inside, against plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 200 and length(text) < 3000").orderBy("doc_id").limit(60)
    base = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    clean = [r for r in base if brute_kept(r[1])]
    item = "a question that no document holds by chance: which river runs past the mill at night"
    rows = base + [(None, t, s) for _, t, s in clean[:8]] + [(clean[0][0], t, s) for _, t, s in clean[8:12]]
    rows += [clean[20]] * 3 + [(None, clean[21][1], "z")] * 4 + [(None, clean[22][1] + f" {item} ", "z"), (clean[23][0], clean[24][1] + f" {item}", "y"), (None, None, None), (5, "", "x"), (None, "", "x")]
    extra = "doc_id long, text string, source string, row binary, n int, `copy` string, rules string, fp long, key string, c0 string"
    df = spark.createDataFrame([(*r, b"x", 1, "c", "r", 2, "k", "z") for r in rows], extra)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, allowed, leaks = plain_pipeline(rows, [decontaminate.normalise(item)])
    from millrace.llm.common import materialised

    stages = dict(corpus_pipeline.STAGES)
    ruled = materialised(stages["quality_rules"](spark, df, str(tmp_path)), "a")
    near = materialised(stages["near_duplicates"](spark, ruled, str(tmp_path)), "b")
    left = materialised(stages["decontaminate"](spark, near, str(tmp_path)), "c")
    mixed = materialised(stages["mix_sources"](spark, left, str(tmp_path)), "d")
    assert all(x.columns == df.columns for x in (ruled, near, left, mixed))
    triples = lambda x: sorted(((r["doc_id"], r["text"], r["source"]) for r in x.collect()), key=str)
    assert triples(ruled) == sorted(kept, key=str)
    got = triples(near)
    assert len(got) == len(allowed) and all(sum((d, t) in a for d, t, _ in got) == 1 for a in allowed.values())
    assert triples(left) == [r for r in got if not leaks(r[1])] and len(triples(left)) < len(got)
    times = {(r["doc_id"], r["text"]): r["taken"] // r["size"] for r in mixture.mix(left).join(left.select("doc_id", "text"), "doc_id").collect() if r["size"]}
    for d, t, s in triples(left):
        n = sum((d, t, s) == x for x in triples(mixed)) if d is not None else None
        assert n is None or n in (0, 1, 2, 3) and (n == times.get((d, t), n) or sum(x[0] == d for x in triples(left)) > 1)
    assert corpus_pipeline.STAGES[-1][1](spark, mixed, str(tmp_path)).count() == len(triples(mixed))


def test_a_source_without_words_and_empty_texts_are_mixed(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "one two", "b"), (4, "", "b"), (5, "three", "b")], "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in mixture.sample(df).collect())
    assert got.count(1) == got.count(2) == 1 and set(got) == {1, 2, 3, 4, 5}
