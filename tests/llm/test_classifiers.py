import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X
from tidemark.llm.queries import QUERIES


def corpus(n=700):
    rng = random.Random(4)
    stem = ["an", "or", "ti", "be", "la", "mo", "ne", "su"]
    word = lambda: "".join(rng.choice(stem) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        good, toxic = 1, 0
        if i % 7 == 0:
            good, w = 0, rng.choice([[x + "***" for x in w], [x.upper() + "!!" for x in w], sum(([x] * 20 for x in w), []), " | ".join(w).split(" ")])
        elif i % 5 == 0:
            toxic = 1
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["scum", "vermin", "zork" + word()])
        if i % 11 == 0 and not toxic:
            w[3:3] = rng.choice([["women"], ["muslims"], ["gay", "men"]])
        docs.append((i, " ".join(w)))
        if i % 10 < 8:
            labels.append((i, good, toxic))
    return docs, labels


EDGES = [(9000, None), (9001, ""), (9002, "  "), (None, "la mo ne"), (9003, "la mo ne"), (9003, "la mo ne"), (9004, "la mo ne " * 20_000)]


def tables(spark, path, docs, labels):
    spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id bigint, text string, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_quality_by_held_out_labels(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path, docs + EDGES, [*labels, (None, 1, 0), (1, None, None)])
    rows = QUERIES["op4_quality"](spark, sf).collect()
    kept = {r.doc_id: r.kept for r in rows if r.doc_id is not None and r.doc_id < 9000}
    wrong_good = [i for i, _ in docs if i % 7 and not kept[i]]
    wrong_bad = [i for i, _ in docs if not i % 7 and kept[i]]
    # k is a share of all documents, a little over that of the good ones: no good one is lost
    told = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    k = round(len(rows) * Q.good_share(sum(q for _, q in told), len(told)))
    assert len(rows) == len(docs) + len(EDGES) and sum(r.kept for r in rows) == k and not wrong_good
    assert len(wrong_bad) <= k - sum(i % 7 > 0 for i, _ in docs)
    again = {(r.doc_id, r.kept, r.log_ratio) for r in QUERIES["op4_quality"](spark, sf).collect()}
    assert again == {(r.doc_id, r.kept, r.log_ratio) for r in rows}
    # with the share known, junk goes too
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = {r.doc_id for r in Q.good(d, lab, share=(600 + len(EDGES)) / len(rows)).collect()}
    assert len([i for i, _ in docs if i % 7 and i not in left]) <= 2 and len([i for i, _ in docs if not i % 7 and i in left]) <= 2


def test_quality_models_and_draw_are_brute_force(spark, tmp_path):
    """Both models, weights and the kept set against plain Python; noise of scale 1 decides."""
    docs, labels = corpus(300)
    docs += [(5000 + i, f"be la {'mo ne ' * (i % 3)}") for i in range(60)]
    sf = tables(spark, tmp_path, docs + EDGES, labels)
    got = QUERIES["op4_quality"](spark, sf).collect()

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return Q.grams(data, np.array([0, len(data)]))[0].tolist()

    good = {i for i, q, _ in labels if q and zlib.crc32(str(i).encode()) % 5}
    target, raw = Counter(), Counter()
    for i, t in docs + EDGES:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    p = lambda c, b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * Q.BUCKETS))
    value = {b: p(target, b) - p(raw, b) for b in raw}
    want = sorted((str(i), round(sum(value[b] for b in buckets(t)), 6)) for i, t in docs + EDGES)
    assert sorted((str(r.doc_id), round(r.log_ratio, 6)) for r in got) == want
    order = sorted((r.score for r in got), reverse=True)
    k = sum(r.kept for r in got)
    assert all(r.kept == (r.score >= order[k - 1]) for r in got)
    noise = np.array([r.score - r.log_ratio for r in got if r.doc_id is None or r.doc_id != 9003])
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - np.pi / np.sqrt(6)) < 0.3  # Gumbel of scale 1
    # of many texts of one weight some are drawn and some aren't
    d = spark.createDataFrame([(i, "be la") for i in range(400)], "doc_id bigint, text string")
    drawn = Q.resample(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), share=0.5).where("__tm_kept").count()
    assert drawn == 200


def test_quality_ratio_is_brute_force():
    a, b = b"x y x y, it is ok", b"!! y !!"
    data = np.frombuffer(a + b, np.uint8)
    at, first = Q.grams(data, np.array([0, len(a), len(a) + len(b)]))
    assert list(first) == [0, 15, 20]  # 8 and 3 tokens, one bigram less than tokens
    v = np.arange(Q.BUCKETS, dtype=float)
    total, n = Q.weigh(v, data, np.array([0, len(a), len(a) + len(b)]))
    assert list(n) == [15, 5] and total[1] == v[at[15:]].sum()


def test_share_and_selection(spark):
    keys = spark.createDataFrame([(float(x % 37),) for x in range(500)], "k double")
    order = sorted((float(x % 37) for x in range(500)), reverse=True)
    for k in (1, 13, 14, 250, 499):
        assert Q.nth_largest(keys, "k", k) == order[k - 1]
    assert Q.nth_largest(keys, "k", 500) == float("-inf") and Q.nth_largest(keys, "k", 0) == float("inf")
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert Q.resample(d, lab, share=0.25).where("__tm_kept").count() == 50


def test_quality_without_labels_or_rows(spark):
    d = spark.createDataFrame(EDGES, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.good(d, none).count() == len(EDGES)
    assert Q.good(d.limit(0), none).count() == 0 and Q.good(d, none).columns == d.columns


def test_toxicity_by_held_out_labels(spark, tmp_path):
    docs, labels = corpus()
    sf = tables(spark, tmp_path, docs + EDGES, [*labels, (None, 1, 1), (1, None, None)])
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    toxic = {i for i, _ in docs if i % 7 and i % 5 == 0}
    said = {r.doc_id for r in rows if r.predicted}
    assert len(rows) == len(docs) + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert len(said - toxic) <= 2 and len(toxic - said) <= 0.03 * len(toxic)


def test_swaps_do_not_change_scores():
    """A term that only toxic texts have is not what makes them toxic."""
    n = 60
    own = [[0, 1] if i % 2 else [] for i in range(n)]  # 0: the identity term, 1: an insult
    swap = [[1] if i % 2 else [] for i in range(n)]
    kind = [[0] * len(r) for r in own]
    label = np.array([i % 2 for i in range(n)])
    w, _ = X.fit(label, own, kind, swap, 2)
    free, _ = X.fit(label, own, kind, own, 2)
    assert abs(w[0]) < 0.15 < free[0] and w[1] > 1
    assert X.swapped("Women and jews, womens") == "men and hindus, womens"


def test_toxicity_without_labels_or_rows(spark):
    d = spark.createDataFrame(EDGES, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert X.score(d, none).agg(F.max("__tm_toxic")).first()[0] < 0.5
    assert X.civil(d, none).count() == len(EDGES) and X.civil(d.limit(0), none).count() == 0


def test_only_copies_are_left_out():
    """Texts that share frequent word pairs but are no copies all teach; copies teach once."""
    rng = random.Random(5)
    common = [f"of the w{i} and it" for i in range(12)]
    texts = [" ".join(x for _ in range(12) for x in (rng.choice(common), f"u{rng.randrange(10**6)} v{rng.randrange(10**6)}")) for _ in range(300)]
    again = texts[:20] + [t.upper() for t in texts[20:40]] + [t + " end" for t in texts[40:60]]
    rows = [(i, t, 0) for i, t in enumerate(texts + again)] + [(1000, texts[0], 1), (1001, "", 0)]
    batch = X.pa.RecordBatch.from_arrays([X.pa.array(c) for c in zip(*rows)], ["row", "text", "label"])
    sketches = next(X._sketch([batch]))
    assert X.firsts(zip(*(c.to_pylist() for c in sketches.columns))) == [*range(300), 1000]


def test_few_toxic_labels(spark):
    """From 3 toxic labels on the insult is found; where nothing tells them, scores are under 0.5."""
    rng = random.Random(6)
    text = lambda *more: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(30)), *more])
    for bad in (3, 5, 7, 10):
        for more in ((), ("vermin",)):
            given = [(i, text(*more) if i < bad else text(), int(i < bad)) for i in range(60)]
            ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5][:60]  # all outside the held-out fold
            docs = spark.createDataFrame([(ids[i], t) for i, t, _ in given] + [(20_000, text("vermin")), (20_001, text())], "doc_id bigint, text string")
            labels = spark.createDataFrame([(ids[i], x) for i, _, x in given], "doc_id bigint, toxic int")
            said = {r.doc_id: r["__tm_toxic"] >= 0.5 for r in X.score(docs, labels).collect()}
            assert said == {**{ids[i]: bool(more) and i < bad for i in range(60)}, 20_000: bool(more), 20_001: False}, (bad, more)


def test_no_feature_and_repeated_ids(spark):
    """A fit without any active feature, and one labelled id with many texts."""
    w, b = X.fit(np.array([1, 0]), [[], []], [[], []], [[], []], 3)
    assert w.shape == (3,) and np.isfinite(b)
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    from tidemark.llm.labelled import sample
    from tidemark.llm.store import Scratch

    assert sorted(r.label for r in sample(docs, labels, "toxic", Scratch(spark), held_out=-1).collect()) == [0, 0]
