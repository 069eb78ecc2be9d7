import numpy as np
import pandas as pd

from tidemark.llm import embeddings as E
from tidemark.llm.queries import QUERIES


def brute(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[x][1], float) / max(map(abs, rows[x][1])) for x in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                near[i].add(j)
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(rows))]
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            name[comp[i]] = min(r[0], name.get(comp[i], r[0]))
    return sorted(((r[0], len(near[i]), name.get(comp[i], r[0]), r[0] is not None and name[comp[i]] == r[0]) for i, r in enumerate(rows)), key=str)


def made():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.03 * rng.standard_normal(16)], int(i % 40 < 25)) for i in range(120)]
    rows += [(200, rows[0][1], rows[0][2]), (200, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (201, rows[0][1], None), (202, None, 1), (203, [], 1), (204, [0.0] * 16, 1)]
    return rows + [(205, [float("nan")] * 16, 1), (206, [None] * 16, 1), (207, [1e300] * 16, 1), (208, [1.0] * 16, 1), (209, [1.0] * 8, 1), (210, [float("inf")] * 16, 1)]


def test_query_is_brute_force_on_clear_pairs(spark, tmp_path):
    rows = made()
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, kept int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((tuple(r) for r in QUERIES["op8_embedding_dedup"](spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_blocks_of_hot_buckets_count_each_link_once(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(32)
    rows = [(i, [float(v) for v in x + 0.05 * rng.standard_normal(32)], 1) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = E.near_duplicates(df, block=20).collect()
    assert {r.n_links for r in out} == {149} and {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = E.unit(rng.standard_normal((400, 64)))
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.935 * a + np.sqrt(1 - 0.935**2) * E.unit(noise)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(800), "embedding": [x.tolist() for x in np.concatenate([a, b])], "label": 1}))
    assert np.mean([r.n_links > 0 for r in E.near_duplicates(df).collect()]) >= 0.97


def test_empty(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = E.near_duplicates(spark.createDataFrame([(1, None, 1)], schema)).collect()
    assert [tuple(r) for r in out] == [(1, 0, 1, True)]


def pairs_at_the_threshold(n, d, seed, cosine=0.932):
    rng = np.random.default_rng(seed)
    a = E.unit(rng.standard_normal((n, d)))
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * E.unit(noise)


def test_recall_is_kept_with_wide_keys():
    """Keys as wide as a thousand million rows ask for: tables are added, or keys made shorter."""
    for d in (16, 32, 64):
        x, _ = pairs_at_the_threshold(4000, d, 1)
        t = E.Tables(x, 0.93, 18)
        a, b = pairs_at_the_threshold(4000, d, 2)
        met = (t.keys(a) == t.keys(b)).any(axis=1) & ((t.bits(a) != t.bits(b)).sum(axis=1) <= t.radius)
        assert t.recall >= 0.99 and met.mean() >= 0.98, (d, t.width, len(t.turns), met.mean())
        far = (t.bits(a) != t.bits(b[::-1])).sum(axis=1) <= t.radius
        assert far.mean() < 0.2


def test_recall_of_the_operator_with_wide_keys_and_other_lengths(spark):
    """Rare lengths, shorter and longer than the commonest, lose no pair."""
    rows = []
    for d, n in ((32, 300), (16, 60), (256, 60), (5, 40)):
        a, b = pairs_at_the_threshold(n, d, d)
        if d == 256:  # all the likeness beyond the first components
            a, b = a * (np.arange(d) >= 64), b * (np.arange(d) >= 64)
        rows += [(len(rows) + i, x.tolist(), 1) for i, x in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for few in (E.FEW, 50):  # without codes, and with codes of each length
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, width=14, few=few).collect()}
        want = {r[0]: r[1:] for r in brute(rows)}
        same = {i: got[i][0] == want[i][0] for i in want}
        assert np.mean(list(same.values())) >= 0.98
        if few == E.FEW:
            assert all(same[i] for i, x, _ in rows if len(x) != 32)


def test_codes_that_tell_nothing_are_made_shorter():
    """Rows so close together that centred codes hide pairs; rows all equal; rows of one component."""
    rng = np.random.default_rng(4)
    close = E.unit(np.ones(24) + 0.05 * rng.standard_normal((500, 24)))
    for x in (close, np.repeat(E.unit(rng.standard_normal((1, 24))), 50, axis=0), np.array([[1.0], [-1.0], [1.0]])):
        t = E.Tables(x, 0.93, 16)
        assert t.recall >= 0.99 and t.keys(x).shape[0] == len(x)


def test_integer_vectors(spark):
    df = spark.createDataFrame([(1, [1, 2], 1), (2, [2, 4], 1), (3, [2, -4], 1)], "vec_id bigint, embedding array<int>, label int")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
