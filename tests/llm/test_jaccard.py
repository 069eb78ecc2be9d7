import random
import re

import numpy as np

from tidemark.llm import jaccard as J
from tidemark.llm.queries import QUERIES


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(docs)), key=str)


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 8, 10, 12, 14, 18, 30, 80, 200]))] for _ in range(40)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):  # near copies at and around the threshold
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            w = w or ["x"]
        if rng.random() < 0.2:
            w = passage + w[: rng.randint(0, 25)]
        docs.append((i, " ".join(w) + rng.choice(["", " ", "\n"])))
    return docs + [(500, None), (501, ""), (502, " \n"), (503, "A b C d E f"), (503, "a b c d e f"), (None, "a b c d e f"), (None, "lonely words of a row without id"), (504, "é " * 20_000), (505, "é " * 20_001)]


def test_query_is_brute_force(spark, tmp_path):
    for seed in (1, 2):
        docs = made(seed)
        path = tmp_path / str(seed)
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, component_id string").repartition(3).write.parquet(f"{path}/documents.parquet")
        assert sorted((tuple(r) for r in QUERIES["op6_jaccard_join"](spark, str(path)).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert J.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_of_each_stays(spark):
    docs = made(3, 60)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in J.one_of_each(df).collect()), key=str)
    groups = brute(docs)
    ids = {c for d, n, c in groups if n and d is not None}
    assert {d for d, t in kept if d is not None and shingles(t)} == ids
    assert [d for d, t in kept].count(503) == 1 and {500, 501, 502} <= {d for d, _ in kept}
    assert (None, "lonely words of a row without id") in kept and (None, "a b c d e f") not in kept


def test_bitmaps_never_understate():
    rng = np.random.default_rng(1)
    for n, m, both in ((10, 12, 8), (100, 90, 85), (300, 500, 20)):
        x = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        assert J.differing(J.bitmap(a), J.bitmap(b)) <= n + m - 2 * both


def test_boundary_has_the_least_cost():
    from math import comb

    rng = random.Random(7)
    for _ in range(20):
        sizes, length = {n: rng.randint(0, 1000) for n in range(1, 40)}, rng.choice([1.0, 2.5, 40.0, 3000.0])

        def cost(light):
            out = 0
            for n, many in sizes.items():
                if n <= light:
                    out += many * sum(comb(n, J.overlap(n, m, 80)) for m in range(-(-80 * n // 100), 100 * n // 80 + 1))
                elif n <= J.MOST:
                    out += many * (n - -(-80 * n // 100) + 1) * (1 + length)
            return out

        assert cost(J.boundary(80, sizes, length)) == min(cost(x) for x in range(J.MOST + 1))
    some = dict.fromkeys(range(1, 30), 10)
    assert J.boundary(80, some, 1.0) < J.boundary(80, some, 1000.0) and J.boundary(80, {}, 1.0) == 0


def test_any_boundary_and_hot_lists_give_the_same(spark, monkeypatch):
    docs = made(5, 120)
    rng = random.Random(8)
    base = [f"h{i}" for i in range(60)]
    for i in range(60):  # near copies of one text: long lists, dealt to several tasks
        w = list(base)
        w[rng.randrange(60)] = f"v{i}"
        docs.append((1000 + i, " ".join(w)))
    df, want = spark.createDataFrame(docs, "doc_id bigint, text string"), brute(docs)
    for light, hot in ((0, 4096), (5, 16), (11, 16)):
        monkeypatch.setattr(J, "boundary", lambda *_, light=light: light)
        monkeypatch.setattr(J, "HOT", hot)
        got = J.classes(df).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want, (light, hot)


def test_functions_travel_without_caches():
    """What a process has cached isn't sent with the functions that use it."""
    from pyspark import cloudpickle

    from tidemark.llm import decontaminate, embeddings, lm, quality, text, toxicity

    decontaminate._words("some words")
    text.powers(1 << 21)
    for f in (J._sketch(5, 22), J._blobs(5), quality._count, toxicity._present, toxicity._sketch, lm._vocabulary, lm._ask(8), embeddings._each(embeddings._link(0.9, "<f4"), None), decontaminate._annotate(None, 0, [])):
        assert len(cloudpickle.dumps(f)) < 100_000
