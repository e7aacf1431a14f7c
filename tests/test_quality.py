from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.quality import contract as C
from millrace.quality import engine as E
from millrace.quality import validators as V

RAW = {
    "name": "orders", "max_quarantine_rate": 0.2,
    "columns": [{"name": "id"}, {"name": "amount", "type": "DOUBLE"}, {"name": "uf", "required": False}, {"name": "at", "type": "TIMESTAMP"}],
    "checks": [
        {"type": "not_null", "column": "id"}, {"type": "range", "column": "amount", "min": 0}, {"type": "accepted_values", "column": "uf", "values": ["SP", "RJ"], "severity": "soft"},
        {"type": "unique", "columns": ["id"]}, {"type": "row_count_between", "min": 1, "max": 100}, {"type": "null_rate_max", "column": "uf", "max": 0.5, "severity": "soft"},
        {"type": "freshness", "column": "at", "max_age_hours": 48}, {"type": "anomaly_mean", "column": "amount", "severity": "soft"},
    ],
}
NOW = datetime(2024, 1, 2)


def batch(spark, n=20, **change):
    rows = [(str(i), "10.5", "SP", "2024-01-01T10:00:00") for i in range(n)]
    for i, r in change.get("at", {}).items():
        rows[i] = r
    return spark.createDataFrame(rows, "id string, amount string, uf string, at string")


def test_clean_batch_is_published(spark):
    out = E.run(batch(spark), C.parse(RAW), NOW)
    assert out.status == "published" and out.published.count() == 20 and not out.warnings
    assert 'dq_check_passed{contract="orders",check="anomaly_mean:amount"' not in E.metrics(out, "orders")
    assert "published" in E.markdown(out, "orders") and E.report(out, "orders")["rows"] == 20


def test_bad_rows_go_to_quarantine_with_all_reasons(spark):
    out = E.run(batch(spark, at={0: ("0", "-1", "XX", "2024-01-01T10:00:00"), 1: ("1", "abc", "SP", "x")}), C.parse(RAW), NOW)
    assert out.status == "published" and out.warnings == ["check accepted_values:uf failed"]
    lost = {r["id"]: r for r in out.quarantine.collect()}
    assert lost["0"]["reasons"] == ["range:amount"] and lost["0"]["amount"] == "-1"
    assert lost["1"]["reasons"] == ["type_cast:amount", "type_cast:at"]
    assert out.published.count() + out.quarantine.count() == 20


@pytest.mark.parametrize("change, reason", [
    (lambda d: d.drop("amount"), "missing column amount"), (lambda d: d.withColumn("new", F.lit("1")), "unexpected column new"), (lambda d: d.limit(0), "empty batch"),
    (lambda d: d.withColumn("id", F.lit("1")), "check unique:id failed"), (lambda d: d.withColumn("at", F.lit("2020-01-01")), "check freshness:at failed"), (lambda d: d.withColumn("amount", F.lit("-1")), "quarantine rate 1.0000 is above 0.2"),
])
def test_blocked(spark, change, reason):
    out = E.run(change(batch(spark)), C.parse(RAW), NOW)
    assert out.status == "blocked" and reason in out.reasons and out.published is None


def test_anomaly_against_history(spark):
    out = E.run(batch(spark), C.parse(RAW), NOW, {"anomaly_mean:amount": [1.0, 1.1, 0.9, 1.0, 1.05]})
    assert out.warnings == ["check anomaly_mean:amount failed"]


def test_optional_column_missing_is_null(spark):
    assert E.run(batch(spark).drop("uf"), C.parse(RAW), NOW).published.where("uf is null").count() == 20


@pytest.mark.parametrize("change", [{"columns": []}, {"columns": [{"name": "a"}, {"name": "a"}]}, {"columns": [{"name": "a", "type": "BLOB"}]}, {"checks": [{"type": "nope"}]}, {"checks": [{"type": "not_null", "column": "zz"}]}, {"checks": [{"type": "null_rate_max", "column": "id", "max": 2}]}, {"max_quarantine_rate": 3}])
def test_wrong_contracts(change):
    with pytest.raises(C.ContractError):
        C.parse(RAW | change)


def test_compatibility_and_yaml(tmp_path):
    old = C.parse(RAW)
    new = C.parse(RAW | {"columns": RAW["columns"] + [{"name": "x"}], "checks": []})
    assert C.compatibility(old, new) == {"backward": ["new required column x"], "forward": []}
    p = tmp_path / "c.yaml"
    p.write_text("name: t\ncolumns:\n  - {name: a, type: bigint}\n")
    assert C.load(p).columns[0].type == "BIGINT"


def test_robust_scores():
    assert E.robust_z_strict(5, [5, 5, 5]) == 0.0 and E.robust_z_strict(6, [5, 5, 5]) is None and E.robust_z_strict(5, [1, 2]) is None
    assert abs(E.robust_z(12, [10, 10, 10])) > 5 and E.robust_z(10, [9, 10, 11]) == 0
    gate = E.batch_gate(100, 10, 20, 10, [100, 101, 99])
    assert not gate["approved"] and gate["hard"] == ["reject_rate"] and gate["soft"] == ["duplicate_rate"]
    with pytest.raises(ValueError):
        E.reject_gate(100, 21, 0.2)
    E.reject_gate(0, 0, 0.2)


def reasons(df):
    return [r["reason"] for r in df.collect()]


def test_lake_lines(spark):
    ok = '{"order_id":"1","customer_id":"c","country":"BR","category":"x","amount":10.005,"status":"paid","order_date":"2024-01-01","updated_at":"2024-01-01T10:00:00"}'
    lines = [ok, "{", "[1]", ok.replace('"c"', '""'), ok.replace("10.005", '"x"'), ok.replace("10.005", "-1"), ok.replace('"2024-01-01",', '"2024-1-1",'), ok.replace("T10:00:00", "T99"), ok.replace("paid", "lost")]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert reasons(V.lake_orders(df)) == [None, "invalid_json", "invalid_json", "missing_field:customer_id", "bad_amount", "negative_amount", "bad_date", "bad_timestamp", "unknown_status"]
    assert reasons(V.lake_orders(df, fold=True))[5:8] == ["bad_amount", "bad_date", "bad_date"]
    valid, rejected = V.split(V.lake_orders(df))
    assert str(valid.first()["amount"]) == "10.00" and valid.count() + rejected.count() == len(lines)


def test_event_messages(spark):
    ok = '{"schema_version":1,"order_id":"o","seq":1,"customer_id":"c","status":"paid","amount":"5.00","event_ts":"2024-01-01T00:00:00Z"}'
    lines = [ok, "", "{bad", ok.replace(":1,", ":99,", 1), ok.replace('"amount":"5.00",', ""), ok.replace('"seq":1', '"seq":0'), ok.replace('"seq":1', '"seq":true'), ok.replace("paid", "zz"), ok.replace("5.00", "x"), ok.replace("2024-01-01T00:00:00Z", "soon")]
    got = reasons(V.order_events(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == [None, "empty_payload", "invalid_json", "unsupported_schema_version:99", "missing_field:amount", "bad_seq", "bad_seq", "unknown_status", "bad_amount", "bad_timestamp"]


def test_csv_validators(spark):
    df = spark.createDataFrame([("1", "c", "1,5", "PAID", "sp", "2024-01-01", None), ("1", "c", "inf", "paid", "sp", "2024-01-01", None), ("", "c", "1", "paid", "sp", "2024-01-01", None), ("1", "c", "1", "paid", "zz", "2024-01-01", None), ("1", "c", "1", "paid", None, "2024-01-02", "2024-01-01")], "order_id string, customer_id string, amount string, status string, uf string, created_at string, updated_at string")
    assert reasons(V.etl_orders(df)) == [None, "invalid amount", "missing order_id", "unknown uf", "updated before created"]
    rows = spark.createDataFrame([("1", " ", "1", "paid", "2024-01-01"), ("1", "c", "1", "Paid ", "2024-01-01"), ("1", "c", "-1", "paid", "2024-01-01")], "order_id string, customer_id string, amount string, status string, order_date string")
    assert reasons(V.object_rows(rows)) == ["missing_field:customer_id", None, "bad_amount"]
