import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records as P
from tidemark.operators import score as M
from tidemark.operators import study as Y
from tidemark.operators.models import logistic
from tidemark.sources import Store

A, B, C = (dt.date(2024, m, 28) for m in (1, 2, 3))


def rows(spark, leak: bool, cutoffs=(A, B, C), n=120):
    out = []
    for k, c in enumerate(cutoffs):
        for i in range(n):
            label = int((i * 7 + k) % 6 == 0)
            out.append((c, i, label, float(label * 3 if leak else (i * 31 + k) % 17), float((i * 13) % 11)))
    return spark.createDataFrame(out, "cutoff date, id bigint, label int, u double, v double")


def fit(a, b):
    return logistic(a, b, ["u", "v"])


def test_permutation_and_reverse_time(spark):
    for leak in (False, True):
        r = rows(spark, leak)
        early, late = r.where(F.col("cutoff") < F.lit(C)), r.where(F.col("cutoff") == F.lit(C))
        got = Y.permutation_check(early, late, fit).first()
        assert got.base_rate == round(20 / 120, 6) and (got.passes or leak)
        shuffled = Y.shuffled_labels(early)
        assert shuffled.groupBy("cutoff").agg(F.sum("label").alias("n")).where("n <> 20").count() == 0
        assert shuffled.join(early.withColumnRenamed("label", "was"), ["cutoff", "id"]).where("label <> was").count() > 20
    assert Y.reverse_time_check(rows(spark, True), fit)["passes"]
    assert Y.reverse_time_check(rows(spark, True, (A,)), fit) == {"skipped": "two cutoffs with positives are needed", "passes": True}
    assert not Y.reverse_verdict(0.2, 0.9, 0.1, 0.1)["passes"] and Y.reverse_verdict(0.2, 0.3, 0.1, 0.1)["passes"] and Y.reverse_verdict(None, 0.9, 0.1, 0.1)["passes"]


def test_forward_lists(spark, tmp_path):
    s = spark.createDataFrame([(c, i, float(i if c == A else 1), 0) for c in (A, B) for i in range(9)], "cutoff date, id bigint, score double, label int")
    listed = Y.forward_list(s, 5)
    assert {r.cutoff for r in listed.collect()} == {A} and listed.count() == 5  # equal scores predict nothing
    store = Store(spark, str(tmp_path))
    Y.commit_list(store, listed)
    with pytest.raises(ValueError):
        Y.commit_list(store, listed)
    acts = spark.createDataFrame([(8, "add", A + dt.timedelta(days=3)), (7, "add", A), (6, "add", A + dt.timedelta(days=99)), (5, "remove", A + dt.timedelta(days=2))], "id bigint, action string, date date")
    back = store.read("forward").drop("dt")
    got = Y.evaluate_forward(back, acts, "2024-12-31", 30, 5).first()
    assert (got.listed, got.designated, got.median_lead_days) == (5, 1, 3.0)
    with pytest.raises(ValueError):
        Y.evaluate_forward(back.withColumn("score", F.when(F.col("id") == 4, 4.5).otherwise(F.col("score"))), acts, "2024-12-31", 30, 5).count()


def test_metrics_without_positives_or_a_side(spark):
    s = spark.createDataFrame([(A, i, float(i), 0) for i in range(5)] + [(B, i, float(i), int(i == 4)) for i in range(5)], "cutoff date, id bigint, score double, label int")
    assert {r.cutoff: r.average_precision for r in M.average_precision(s).collect()} == {A: None, B: 1.0}
    assert {r.cutoff: (r.average_precision, r.precision_2) for r in Y.summary(s, (2, 3)).collect()} == {A: (None, None), B: (1.0, 0.5)}
    one = spark.createDataFrame([(0, float(i)) for i in range(20)], "side int, v double")
    assert [r.psi for r in M.psi(one, "side", ["v"]).collect()] == [None]


def test_gate_and_families(spark):
    m = spark.createDataFrame([(A, 0.5)], "cutoff date, precision double")
    check = lambda *x: spark.createDataFrame([(v,) for v in x], "passes boolean")
    assert Y.gated(m, check(True, True)).count() == 1 and Y.gated(m, check(True, False)).count() == 0 and Y.gated(m, check(None)).count() == 0
    assert Y.gated(m, check()).count() == 1


def test_prefixes_and_names(spark):
    t = lambda *r: spark.createDataFrame(r, "prefix int, country string")
    assert P.prefix_table(t((201, "X"), (201, "X"), (202, None)), {}).collect() == [(201, "X")]
    with pytest.raises(ValueError):
        P.prefix_table(t((201, "X"), (201, "Y")), {})
    p = P.prefix_table(t((201, "X"), (201, "Y"), (300, "Z")), {201: "Y"})
    got = P.flag_by_prefix(spark.createDataFrame([(201000001,), (300123456,), (99,), (901000000,), (None,)], "mmsi bigint"), p).collect()
    assert [r.flag for r in got] == ["Y", "Z", None, None, None]
    names = spark.createDataFrame([(" oryx ",), ("UNKNOWN",), ("LA*K#",), ("St. Mary's",), (None,)], "name string")
    assert [r.n for r in names.select(P.clean_name("name").alias("n")).collect()] == ["ORYX", None, None, "ST. MARY'S", None]


def test_flagged_drivers_and_review(spark):
    s = spark.createDataFrame([(A, 1, 5.0, 0, 2.0, 3.0), (A, 2, 1.0, 1, 1.0, 0.0), (A, 3, 0.0, 0, 0.0, 0.0), (B, 1, 9.0, 0, 9.0, 0.0)], "cutoff date, id bigint, score double, label int, p double, q double")
    got = {(r.cutoff, r.id): (r["rank"], r.drivers) for r in Y.flagged(s, ["p", "q"], 2).collect()}
    assert got == {(A, 1): (1, ["q=3.000", "p=2.000"]), (A, 2): (2, ["p=1.000"]), (B, 1): (1, ["p=9.000"])}
    assert [(r.quarter, r.id, r.place) for r in Y.review_sheet(s).orderBy("place").collect()] == [("2024-Q1", 1, 1), ("2024-Q1", 3, 2)]


def test_dossiers_are_bounded_and_ordered(spark):
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, d), "gap", d) for d in range(1, 20)], "mmsi bigint, observed_at timestamp, kind string, event_id bigint").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    at = spark.createDataFrame([(dt.date(2024, 1, 10), 1, "e")], "cutoff date, mmsi bigint, entity string")
    got = P.dossiers(ev, at, 3).first()
    assert got.n == 10 and [e.event_id for e in got.events] == [8, 9, 10]
