import duckdb

from tidemark.llm import mixing as M
from tidemark.llm.queries import QUERIES, SQL

DOCS = [(i, "w " * (i % 7), ["a", "b", "c", None][i % 4 if i % 10 else 0], 5) for i in range(300)] + [(1, "w", "a", 5), (1, "w", "a", 5), (None, "x y", "a", 5), (None, "x y", "a", 5), (400, None, "b", 5), (401, "", "z", 5), (402, "v " * 5000, "long", 5)]


def test_query_agrees_with_sql(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, text string, source string, size int").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_mix"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(SQL["op3_mix"]).df()
    key = lambda d: sorted((str(r.doc_id).removesuffix(".0").replace("<NA>", "nan"), r.size_, r.source_size, round(r.target, 9), r.taken) for r in d.rename(columns={"size": "size_"}).itertuples())
    assert key(got) == key(want)
    by = got.groupby("source_size").agg(t=("target", "first"), n=("taken", "sum"))
    assert (got.taken <= 3 * got["size"]).all() and got.source_size.nunique() >= 4 and ((by.t - by.n).abs() < 1).any()


def test_targets_are_a_fixed_point(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, "e": 500, None: 40}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3]))
    want, full, total = {}, set(), sum(sizes.values())
    while True:  # share, stop, reshare
        left = total - sum(3 * sizes[s] for s in full)
        want = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes}
        over = {s for s in sizes if want[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - total) < 1e-6


def test_budget_is_exact_and_order_does_not_matter(spark):
    docs = spark.createDataFrame([(d, t, s) for d, t, s, _ in DOCS], "doc_id bigint, text string, source string")
    a = M.mix(docs).toPandas()
    b = M.mix(docs.repartition(7)).toPandas()
    c = M.mix(docs, ranges=2).toPandas()
    cols = ["doc_id", "size", "taken"]
    assert a[cols].value_counts().to_dict() == b[cols].value_counts().to_dict() == c[cols].value_counts().to_dict()
    for _, g in a.groupby(a.source.fillna("-")):
        assert g.taken.sum() == int(g.target.iloc[0])
    assert M.mix(docs.limit(0)).count() == 0
