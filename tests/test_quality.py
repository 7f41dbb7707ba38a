import pytest
from pyspark.sql import functions as F

from laketide.functions.scalars import first_reason, normalize_category, parse_date, row_fingerprint
from laketide.operators import quality as dq

CONTRACT = {
    "columns": {
        "id": {"nullable": False},
        "tax_id": {"nullable": False, "pattern": r"^\d{9}$"},
        "amount": {"min": 0.0},
        "status": {"allowed": ["approved", "pending", "rejected"]},
        "month": {"min": 1, "max": 12, "severity": "warning"},
    }
}
SCHEMA = "id int, tax_id string, amount double, status string, month int"
GOOD = (1, "123456789", 10.0, "approved", 5)


@pytest.fixture(scope="module")
def batch(spark):
    rows = [
        GOOD,
        (2, "12345", 10.0, "approved", 5),
        (3, "123456789", -1.0, "approved", 5),
        (4, "123456789", 1.0, "lost", 5),
        (5, "123456789", 1.0, "approved", 15),
        (None, None, -1.0, "??", 0),
        (7, "123456789", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_broken_row_is_caught_once(batch):
    rules = dq.contract_rules(CONTRACT)
    valid, invalid = dq.split(dq.annotate(batch, rules), rules)
    assert sorted(r.id for r in valid.collect()) == [1, 5, 7]
    reasons = {r.id: r.failed_rules for r in invalid.collect()}
    assert reasons[2] == "[tax_id_pattern]" and reasons[3] == "[amount_min]" and reasons[4] == "[status_allowed]"
    assert reasons[None] == "[id_null][tax_id_null][amount_min][status_allowed][month_min]"
    assert valid.where("id = 5").first().failed_rules == "[month_max]"
    metrics = {r.rule: (r.failed, r.total) for r in dq.rule_metrics(batch, rules).collect()}
    assert metrics["amount_min"] == (2, 7) and metrics["month_max"] == (1, 7)


def test_null_policies_place_undecidable_rows(batch):
    rule = [dq.Rule("r", F.col("amount") < 0)]
    sides = {p: tuple(d.count() for d in dq.split(batch, rule, p)) for p in ("drop", "fail", "pass")}
    assert sides == {"drop": (4, 2), "fail": (4, 3), "pass": (5, 2)}


def test_gate_stops_a_bad_batch_and_allows_an_empty_one(batch):
    rules = dq.contract_rules(CONTRACT)
    metrics = dq.batch_metrics(batch, rules).first().asDict()
    assert (metrics["total"], metrics["valid"], metrics["invalid"]) == (7, 3, 4)
    dq.gate(metrics, 60.0)
    with pytest.raises(dq.BatchRejected):
        dq.gate(metrics, 50.0)
    empty = dq.batch_metrics(batch.where("1 = 0"), rules).first().asDict()
    assert empty["invalid_pct"] == 0.0
    dq.gate(empty, 0.0)


def test_non_ascii_columns_are_quoted_only_where_they_are_names():
    columns = ["Ποσό", "Ποσό_EUR", "plain", "two words"]
    assert dq.quote_columns("Ποσό_EUR >= 0 AND Ποσό < 1", columns) == "`Ποσό_EUR` >= 0 AND `Ποσό` < 1"
    assert dq.quote_columns("plain = 'Ποσό' AND `Ποσό` = 1", columns) == "plain = 'Ποσό' AND `Ποσό` = 1"
    assert dq.quote_columns("two words = 1", columns) == "`two words` = 1"
    assert dq.quote_columns("a = 1", ["a"]) == "a = 1"


def test_sql_rules_on_greek_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -5.0), (3, None)], "id int, `Ποσό` double")
    rules = dq.sql_rules([{"id": "R", "expression": "Ποσό >= 0", "severity": "error"}], df.columns)
    m = dq.rule_metrics(df, rules).first()
    assert (m.failed, m.unknown, m.total) == (1, 1, 3)


def test_expectations_warn_drop_and_fail(batch):
    out = dq.expectations(batch, warn=[dq.Rule("month", F.col("month") > 12)], drop=[dq.Rule("id", F.col("id").isNull())])
    assert out.count() == 6 and out.where("id = 5").first().warnings == "[month]"
    with pytest.raises(Exception, match="expectation amount failed"):
        dq.expectations(batch, fail=[dq.Rule("amount", F.col("amount") < 0)]).collect()


def test_rule_table_with_every_kind_of_rule(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "zz", 7), (3, None, -1)], "id int, ref string, v int")
    ref = spark.createDataFrame([("a",)], "key string")
    table = [
        {"rule_id": "U", "rule_type": "uniqueness", "rule_expression": "id UNIQUE", "action_on_fail": "deduplicate", "severity": "warn"},
        {"rule_id": "E", "rule_type": "referential_integrity", "rule_expression": "ref EXISTS IN parents", "action_on_fail": "quarantine", "severity": "error"},
        {"rule_id": "R", "rule_type": "range", "rule_expression": "v BETWEEN 0 AND 240", "action_on_fail": "reject_batch", "severity": "error"},
    ]
    flagged, rules = dq.rule_table_rules(df, table, {"parents": (ref, "key")})
    good, bad, outcome = dq.apply_rule_actions(df, flagged, rules, ["id"], ["v"])
    assert [tuple(r) for r in good.collect()] == [(1, "a", 6)]
    assert sorted(r.id for r in bad.collect()) == [2, 3]
    assert {r.rule: (r.failed, r.fired) for r in outcome.collect()} == {"U": (2, True), "E": (2, True), "R": (1, True)}


def test_schema_and_null_share_reports(spark, batch):
    drift = sorted(tuple(r) for r in dq.schema_drift(batch, ["id", "tax_id", "region"]).collect())
    assert drift == [("amount", "extra", 6), ("month", "extra", 6), ("region", "missing", 0), ("status", "extra", 6)]
    assert dq.schema_drift(batch, batch.columns).isEmpty()
    shares = {r["column"]: r.breached for r in dq.null_percentages(batch, {"id": 20.0, "status": 10.0}).collect()}
    assert shares == {"id": False, "status": True}


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("2024-01-31", "F"), ("2024/02/01", "pending "), ("31.01.2024", None)], "d string, s string")
    got = df.select(
        parse_date("d").cast("string").alias("d"),
        normalize_category("s", ["F", "pending"]).alias("s"),
        first_reason({"NULL": F.col("s").isNull(), "SHORT": F.length("s") < 2}).alias("r"),
    ).collect()
    assert [r.d for r in got] == ["2024-01-31", "2024-02-01", None]
    assert [r.s for r in got] == ["F", "UNKNOWN", "UNKNOWN"]  # not trimmed first, so the padded value is unknown
    assert [r.r for r in got] == ["SHORT", None, "NULL"]
    pair = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(row_fingerprint(["x", "y"]).alias("h"))
    assert pair.distinct().count() == 2


def test_a_fail_rule_is_not_hidden_by_a_drop_rule(spark):
    batch = spark.createDataFrame([(None, -1.0), (1, 2.0)], "id int, amount double")
    with pytest.raises(dq.ExpectationFailed):
        dq.expectations(batch, drop=[dq.Rule("id", F.col("id").isNull())], fail=[dq.Rule("amount", F.col("amount") < 0)]).collect()
