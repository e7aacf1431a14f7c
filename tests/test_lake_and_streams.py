import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.lake import LakeTable
from millrace.plans import runner
from millrace.plans.lakehouse import Lakehouse, days_between, silver_from_bronze, store_bronze
from millrace.sources import files, generators, rest, sinks, store
from millrace.streaming import clicks, stateful


def table(spark, tmp_path, *parts):
    return LakeTable(spark, f"file://{tmp_path}/t", parts)


def test_versions_restore_history_vacuum(spark, tmp_path):
    t = table(spark, tmp_path)
    t.overwrite(spark.range(3))
    t.append(spark.range(3, 5))
    assert t.read().count() == 5 and t.read(0).count() == 3
    with pytest.raises(ValueError):
        t.append(spark.range(2).select(F.col("id").cast("string").alias("id")))
    t.restore(0)
    assert t.read().count() == 3 and [h["operation"] for h in t.history()] == ["overwrite", "append", "restore"]
    extra = t.vacuum(1, dry_run=True)
    assert extra and t.read(1).count() == 5
    t.vacuum(1, dry_run=False)
    assert t.read().count() == 3 and t.versions() == [2]
    with pytest.raises(ValueError):
        t.read(1)


def test_second_writer_of_a_version_fails(spark, tmp_path):
    t = table(spark, tmp_path)
    t.overwrite(spark.range(1))
    with pytest.raises(Exception, match="exist"):
        t._commit([], spark.range(1).schema, "late", None)


def test_partitions_compaction_pruning(spark, tmp_path):
    t = table(spark, tmp_path, "d")
    df = spark.range(100).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("d")).repartition(3)
    t.overwrite(df)
    assert t.pruning("d", "2024-01-02", "2024-01-03")["files_scanned"] < t.pruning("d", "2024-01-01", "2024-01-04")["files_total"]
    r = t.compact(1)
    assert r["after"] == 4 < r["before"] and r["rows"] == 100 and len(t.inventory()) == 4
    t.overwrite_partitions(df.where("d = '2024-01-02'").limit(1))
    assert t.read().count() == 76
    t.cluster(["id"], 2)
    assert t.read().count() == 76
    t.delete_where("d < '2024-01-03'")
    assert t.read().count() == 50


def test_merge_and_publish(spark, tmp_path):
    t = table(spark, tmp_path)
    a = spark.createDataFrame([("x", 1), ("y", 5)], "k string, v int")
    t.merge(a, ["k"], "v")
    t.merge(spark.createDataFrame([("x", 2), ("y", 3), ("z", 1)], "k string, v int"), ["k"], "v")
    assert sorted(tuple(r) for r in t.read().collect()) == [("x", 2), ("y", 5), ("z", 1)]
    v, wrote = t.publish(a)
    assert wrote and t.publish(a.orderBy(F.desc("k"))) == (v, False)


def line(i, at, status="paid", day="2024-01-01", amount="10.00"):
    return json.dumps({"order_id": str(i), "customer_id": "c", "country": "BR", "category": "x", "amount": amount, "status": status, "order_date": day, "updated_at": at})


def test_days_run_twice_never_regress_and_block(spark, tmp_path):
    lake = Lakehouse(spark, f"{tmp_path}/lake")
    one = "\n".join([line(i, "2024-01-01T08:00:00", "created") for i in range(30)] + ["{"]).encode()
    assert lake.run_day("2024-01-01", one).status == "success"
    rows = sorted(map(tuple, lake.silver.read().collect()))
    assert lake.run_day("2024-01-01", one).rejected == 1 and sorted(map(tuple, lake.silver.read().collect())) == rows and lake.rejects.read().count() == 1
    two = "\n".join([line(0, "2024-01-02T12:00:00", "shipped"), line(0, "2024-01-02T09:00:00", "paid"), line(1, "2024-01-01T07:00:00", "canceled")] + [line(i, "2024-01-02T01:00:00") for i in range(40, 70)]).encode()
    assert lake.run_day("2024-01-02", two).exit_code == 0
    state = {r["order_id"]: r["status"] for r in lake.silver.read().collect()}
    assert state["0"] == "shipped" and state["1"] == "created" and len(state) == 60
    bad = "\n".join([line(99, "2024-01-03T01:00:00")] + ["{"] * 5).encode()
    day = lake.run_day("2024-01-03", bad)
    assert day.status == "blocked" and day.exit_code == 2 and lake.silver.read().count() == 60
    with pytest.raises(PermissionError):
        lake.load_silver("2024-01-03")
    gold = lake.gold["daily_revenue"].read().agg(F.sum("orders"), F.sum("revenue")).first()
    assert gold[0] == lake.silver.read().where("status <> 'canceled'").count()
    assert days_between("2024-02-28", "2024-03-01") == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_bronze_is_immutable_and_lines_keep_their_place(spark, tmp_path):
    content = f"{line(1, '2024-01-01T08:00:00')}\n\n{line(1, '2024-01-01T08:00:00', 'shipped')}\nx\n".encode()
    path, new = store_bronze(str(tmp_path / "b"), "2024-01-01", content)
    assert new and store_bronze(str(tmp_path / "b"), "2024-01-01", content) == (path, False)
    assert [r["line_no"] for r in files.json_lines(spark, path).orderBy("line_no").collect()] == [1, 3, 4]
    assert [r["line_no"] for r in files.json_lines(spark, path, count_blank=False).orderBy("line_no").collect()] == [1, 2, 3]
    silver, rejected = silver_from_bronze(spark, str(tmp_path / "b"))
    assert silver.first()["status"] == "shipped" and rejected.first()["reason"] == "invalid_json"


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_bytes('﻿id,name\n1,"a\nb"\n2,"say ""x"""\n'.encode())
    got = files.csv_text(spark, str(p))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", "a\nb"), ("2", 'say "x"')]
    assert files.csv_indexed(spark, str(p)).select("_rn").distinct().count() == 2
    with pytest.raises(files.PermanentError):
        files.object_csv(spark, str(p), ["id", "amount"])
    assert files.object_csv(spark, str(p), ["id"]).count() == 2


def test_rest_pages_and_retries():
    answers = {"http://a?limit=2": [(503, {}, b""), (200, {}, b'{"results":[{"id":1},{"id":2}],"next":"http://a/2"}')], "http://a/2": [(429, {"Retry-After": "7"}, b""), (200, {}, b'{"results":[{"id":3}]}')], "http://b?limit=1": [(404, {}, b"")], "http://c?limit=1": [(500, {}, b"")] * 9}
    waits = []
    fetch = lambda u: answers[u].pop(0)
    assert [r["id"] for r in rest.pages("http://a", page_size=2, fetch=fetch, sleep=waits.append)] == [1, 2, 3] and waits == [1.0, 7.0]
    for base in ("http://b", "http://c"):
        with pytest.raises(OSError):
            list(rest.pages(base, page_size=1, fetch=fetch, sleep=waits.append))
    assert len(answers["http://c?limit=1"]) == 4


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.make_events(spark, 2000, 50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    share = a.where(F.col("user_id") == generators.HOT_USER).count() / 2000
    assert 0.35 < share < 0.47 and generators.make_users(spark, 10).count() == 10


BASE = datetime(2024, 1, 1, 12, 0, 0)


def click(i, s, page="p", user="u"):
    return {"event_id": f"e{i}", "user_id": user, "page": page, "event_time": (BASE + timedelta(seconds=s)).isoformat()}


def test_windowed_counts_late_duplicates_rejects_and_restart(spark, tmp_path):
    phases = [
        [json.dumps(click(i, i * 10)) for i in range(30)] + ["{bad", json.dumps({"event_id": "", "user_id": "u", "page": "p", "event_time": "2024-01-01"})],
        [json.dumps(click(0, 0)), json.dumps(click(29, 290))] + [json.dumps(click(100 + i, 300 + i * 10, user=f"u{i}")) for i in range(20)],
        [json.dumps(click(500, 100)), json.dumps(click(501, 470)), json.dumps(click(502, 900))],
    ]
    src = tmp_path / "in"
    src.mkdir()
    t = LakeTable(spark, f"file://{tmp_path}/counts")
    batches, dropped = [], 0
    for n, lines in enumerate(phases):
        (src / f"{n}.json").write_text("".join(json.dumps({"partition": 0, "offset": i, "value": v}) + "\n" for i, v in enumerate(lines)))
        parsed = clicks.parse(clicks.replay_source(spark, str(src)))
        q = clicks.run_available(clicks.windowed_counts(parsed), clicks.LedgerSink(t, ["window_start", "page"], "counts"), str(tmp_path / "ck"))
        dropped += clicks.progress(q)["dropped_late"]
        ok = [json.loads(v) for v in lines if v != "{bad" and json.loads(v)["event_id"]]
        batches.append([e | {"event_time": datetime.fromisoformat(e["event_time"])} for e in ok])
    want = clicks.expected_counts(batches)
    got = {(r["window_start"], r["page"]): (r["views"], r["users"]) for r in t.read().collect()}
    assert got == want["windows"] and dropped == want["late"] == 2 and want["duplicates"] == 1
    versions = t.versions()
    clicks.run_available(clicks.windowed_counts(clicks.parse(clicks.replay_source(spark, str(src)))), clicks.LedgerSink(t, ["window_start", "page"], "counts"), str(tmp_path / "ck"))
    assert {(r["window_start"], r["page"]): (r["views"], r["users"]) for r in t.read().collect()} == got and len(t.versions()) >= len(versions)
    static = clicks.parse(spark.createDataFrame([(v,) for v in phases[0]], "value string"))
    assert sorted(r["reason"] for r in clicks.rejects(static).collect()) == ["invalid_json", "missing_or_bad_field"]


def test_ledger_applies_a_batch_once_and_state_only_advances(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/state")
    sink = clicks.LedgerSink(t, ["order_id"], "q", combine=clicks.advance_only)
    rows = lambda *r: spark.createDataFrame(list(r), "order_id string, seq int, status string")
    sink(rows(("a", 2, "paid"), ("a", 1, "created")), 0)
    sink(rows(("a", 9, "lost")), 0)
    assert [tuple(r) for r in t.read().collect()] == [("a", 2, "paid")]
    sink(rows(("a", 1, "created"), ("b", 1, "created")), 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 2, "paid"), ("b", 1, "created")] and sink.applied() == 1


def test_running_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text("".join(json.dumps({"user_id": u}) + "\n" for u in "aab"))
    df = spark.readStream.schema("user_id string").json(str(src))
    out = {}
    q = stateful.running_counts(df).writeStream.outputMode("update").foreachBatch(lambda b, n: out.update({r["key"]: r["events"] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:  # timeouts keep such a query alive, so it is stopped when the rows are through
        for _ in range(60):
            if out == {"a": 2, "b": 1} or q.awaitTermination(1):
                break
    finally:
        q.stop()
    assert out == {"a": 2, "b": 1}


def test_day_range_is_read_from_a_whole_table(spark, data):
    """The registered query writes every day before it prunes."""
    orders = spark.read.parquet(f"{data}/orders.parquet")
    files_read = catalog.QUERIES["SRC-08"](spark, data).inputFiles()
    root = files_read[0].rsplit("/d=", 1)[0]
    assert spark.read.parquet(root).count() == orders.count()


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.overwrite(spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(store, "_appear", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # after the bytes are written, before the name
        with pytest.raises(KeyboardInterrupt):
            t.append(spark.range(3, 5))
    assert t.versions() == [0] and t.read().count() == 3
    t.append(spark.range(3, 5))
    assert t.versions() == [0, 1] and t.read().count() == 5
    left = t.vacuum(2, dry_run=True)
    assert left == [] and t.vacuum(2, dry_run=True, grace_hours=-1)  # the dead writer's file waits for its time


def names(t, version=None):
    return {f["path"] for f in t.manifest(version)["files"]}


def test_merges_and_deletes_rewrite_touched_files_only(spark, tmp_path):
    t = table(spark, tmp_path)
    t.overwrite(spark.range(100).select("id", F.lit(1).alias("v")).repartitionByRange(5, "id"))
    assert len(names(t)) == 5
    t.merge(spark.createDataFrame([(3, 2), (200, 2)], "id long, v int"), ["id"], "v")
    assert len(names(t) & names(t, 0)) == 4 and t.read().count() == 101 and t.read().where("id = 3").first()["v"] == 2
    t.delete_where("id between 90 and 95")
    assert len(names(t) & names(t, 1)) >= 4 and t.read().count() == 95
    sink = clicks.LedgerSink(t, ["id"], "q")
    sink(spark.createDataFrame([(50, 7)], "id long, v int"), 0)
    sink(spark.createDataFrame([(50, 9)], "id long, v int"), 0)
    assert len(names(t) & names(t, 2)) >= 4 and t.read().where("id = 50").first()["v"] == 7 and t.read().count() == 95
    p = LakeTable(spark, f"file://{tmp_path}/p", ("d",))
    p.overwrite(spark.range(12).select("id", F.concat(F.lit("a b="), F.col("id") % 3).alias("d"), F.lit(1).alias("v")))
    p.merge(spark.createDataFrame([(4, "a b=1", 5)], "id long, d string, v int"), ["id"], "v")
    assert {f.split("/")[1] for f in names(p) - names(p, 0)} == {next(f.split("/")[1] for f in names(p) if f.split("/")[1].endswith("1"))}
    assert p.read().count() == 12 and p.read().where("v = 5").first()["d"] == "a b=1" and p.read().where("d = 'a b=2'").count() == 4


def test_many_appends_are_one_scan_and_few_lists(spark, tmp_path, monkeypatch):
    from millrace.lake import table as module

    monkeypatch.setattr(module, "MOST_LISTS", 4)
    t = table(spark, tmp_path)
    for i in range(9):
        t.append(spark.range(i, i + 1))
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and t.read().count() == 9 and len(t.manifest()["lists"]) <= 5


def test_gates_outlive_the_process_and_only_published_days_are_the_baseline(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    day = lambda n, ds, bad=0: "\n".join([line(f"{ds}-{i}", f"{ds}T08:00:00", day=ds) for i in range(n)] + ["{"] * bad).encode()
    first = Lakehouse(spark, path)
    assert first.run_day("2024-01-01", day(30, "2024-01-01")).status == "success"
    assert first.run_day("2024-01-02", day(30, "2024-01-02", 20)).status == "blocked"
    again = Lakehouse(spark, path)
    assert again.gate("2024-01-01")["approved"] and not again.gate("2024-01-02")["approved"] and again.volumes("2024-01-03") == [30]
    again.load_silver("2024-01-01")
    with pytest.raises(PermissionError):
        again.load_silver("2024-01-02")


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    rows = [f'{{"n": {i}}}' if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\r\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = files.json_lines(spark, str(tmp_path / "a.jsonl"))
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 3
        assert sorted((r["line_no"], r["raw"]) for r in df.collect()) == [(i + 1, r) for i, r in enumerate(rows) if r]
        few = files.json_lines(spark, str(tmp_path / "a.jsonl"), count_blank=False)
        assert sorted(r["line_no"] for r in few.collect()) == list(range(1, sum(map(bool, rows)) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_users_are_counted_without_being_gathered(spark):
    clicks_in = [json.dumps(click(i, i % 50, user=f"u{i % 90}")) for i in range(300)] + [json.dumps(click(0, 0, user="u0"))]
    out = clicks.windowed_counts(clicks.parse(spark.createDataFrame([(v,) for v in clicks_in], "value string")))
    assert [(r["views"], r["users"]) for r in out.collect()] == [(300, 90)]
    assert "collect_set" not in out._jdf.queryExecution().analyzed().toString()


def test_days_run_with_retries_and_stop_at_permanent_errors():
    waits, calls = [], []

    def flaky(ds, results):
        calls.append(ds)
        if len(calls) < 3:
            raise OSError("busy")
        return 7

    def bad(ds, results):
        raise files.PermanentError("gate")

    run = runner.run_day("2024-01-01", [("extract", flaky), ("load", lambda ds, r: r["extract"] + 1)], sleep=waits.append)
    assert run.results == {"extract": 7, "load": 8} and run.attempts["extract"] == 3 and waits == [10.0, 10.0] and run.exit_code == 0
    run = runner.run_day("2024-01-01", [("check", bad), ("load", flaky)], sleep=waits.append)
    assert run.exit_code == 2 and run.attempts == {"check": 1} and len(waits) == 2

    def down(ds, results):
        raise OSError("down")

    assert runner.run_day("2024-01-01", [("extract", down)], retries=1, sleep=waits.append).exit_code == 1


def test_rows_go_out_in_batches(spark, tmp_path):
    def send(rows):
        (tmp_path / f"{rows[0]['id']}").write_text(str(len(rows)))

    sinks.in_batches(spark.range(0, 25, 1, 2), 10, send)
    assert sorted(int(f.read_text()) for f in tmp_path.iterdir()) == [2, 3, 10, 10]


def test_partitions_by_size(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 5).alias("p"))
    sinks.by_partition(df, f"{tmp_path}/x", ["p"])
    assert spark.read.parquet(f"{tmp_path}/x").count() == 1000 and "RebalancePartitions" in df.hint("rebalance", "p")._jdf.queryExecution().optimizedPlan().toString()
