import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lm as L
from tidemark.llm.queries import QUERIES

DOCS = [(i, " ".join(f"W{(i * 7 + j * j) % 23}" for j in range(i % 40))) for i in range(120)] + [(200, None), (201, ""), (None, "w1 w2"), (5, "dup row"), (5, "dup row"), (202, "é x " * 30_000)]


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


def test_query_has_the_exact_base_score(spark, tmp_path):
    spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id bigint, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(x for d, t in DOCS if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(tokens(t)), sum(1 for x in tokens(t) if c[x]), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 3)) for d, t in DOCS), key=str)
    got = QUERIES["op5_lm_score"](spark, str(tmp_path)).toPandas()
    assert sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got.itertuples()), key=str) == want
    assert (got.score <= 0).all() and np.isfinite(got.score).all()
    assert got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_rare_tokens_meet_their_counts_in_the_join(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS[:60], "doc_id bigint, text string")
    train = F.col("doc_id") % 5 != 1
    one = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in L.score(docs, train).collect()}
    monkeypatch.setattr(L, "HEAVY", 1 / 30)
    assert {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in L.score(docs, train).collect()} == one


def test_filter_returns_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 40, 20_000, dtype=np.uint64)
    want = L.level(rng.zipf(1.5, len(h)).clip(1, 10**9), 1) * (rng.random(len(h)) < 0.7)
    f = L.Filter(h, want)
    got = f.levels(h)
    assert f.on.nbytes * 8 <= want.sum() * L.BITS_EACH + 64
    assert (got >= want).all() and (got > want).mean() < 0.01  # never less; more where a probe is wrong
    assert (f.levels(rng.integers(0, 1 << 40, 200_000, dtype=np.uint64)) > 0).mean() < 0.01
    assert (L.Filter(h[:0], want[:0]).levels(h) == 0).all()


def test_probabilities_add_up_to_one_at_most(monkeypatch):
    """Over all tokens of the vocabulary, after contexts that were seen, partly seen and not seen."""
    monkeypatch.setattr(L, "BITS_EACH", 60)
    texts = [" ".join(f"w{(i * i + j * j) % 11}" for j in range(12)) for i in range(40)]
    vocabulary = sorted({w for t in texts for w in t.split()})
    contexts = ["", "w0", "w0 w1", "w1 w4", "w4 w4", "new", "new w1", "w1 new", "w9 w9 w9"]
    data = [L.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])) for x in texts]
    grams = [L.ngrams(*L.tokens(w))[0] for w in data]
    flat = {n: np.concatenate([g[n] for g in grams]) for n in (1, 2, 3)}
    filters = {n: L.Filter(*(lambda h, k: (h, L.level(k, n)))(*np.unique(flat[n], return_counts=True))) for n in flat}
    total, distinct = len(flat[1]), len(np.unique(flat[1]))
    for c in contexts:
        mass = 0.0
        for v in [*vocabulary, None]:
            x = c if v is None else f"{c} {v}".strip()
            w = L.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))
            t, first = L.tokens(w)
            g = L.ngrams(t, first)[0]
            p = L.log10({n: filters[n].levels(g[n]) for n in g}, float(len(texts)), first, total, distinct)
            mass += 10 ** p[len(c.split())]
        assert 0.5 < mass <= 1 + 1e-9, c


def test_empty_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in L.score(docs, F.lit(False)).collect()}
    assert out[1].train_tokens == 0 and out[1].base_score == 0 and out[1].n_known == 0 and out[2].n_tokens == 1
    assert L.score(docs.limit(0), F.lit(True)).count() == 0


def test_scores_hold_every_ngram_whatever_the_size(spark, monkeypatch):
    """Scores are those of the quantised counts of all n-grams, and the model has no bound."""
    monkeypatch.setattr(L, "BITS_EACH", 80)  # so that no probe is wrong
    monkeypatch.setattr(L, "AT_ONCE", 300)
    monkeypatch.setattr(L, "PROBED", 300)
    monkeypatch.setattr(L, "PACK_BYTES", 400)
    assert not hasattr(L, "MAX_BITS")
    docs = DOCS[:60] + [(300 + i, f"once{i} twice{i} thrice{i}") for i in range(40)]
    train = [(d, t) for d, t in docs if d % 5 != 1]
    grams = lambda t: [tuple((["<s>"] * 2 + tokens(t))[i + 3 - n : i + 3] for n in (1, 2, 3)) for i in range(len(tokens(t)))]
    c = Counter((n, *g) for _, t in train for x in grams(t) for n, g in enumerate(x, 1))
    total, distinct = sum(v for k, v in c.items() if k[0] == 1), sum(k[0] == 1 for k in c)

    def bound(n, g):
        return [float(x[0]) for x in L.bounds(np.array([int(L.level(np.array([c[n, *g]]), n)[0]) if c[n, *g] else 0]), n)]

    def want(t):
        out = 0.0
        for i, (one, two, three) in enumerate(grams(t)):
            low = bound(1, one)[0]
            p = (low + 0.5) / (total + 0.5 * (distinct + 1))
            before = len(train) if i == 0 else bound(1, two[:1])[1]
            low2 = min(bound(2, two)[0], low) if before else 0.0
            if before:
                p = (low2 + 100 * p) / (max(before, low2) + 100)
            context = bound(2, three[:2])[1] if i > 0 and c[1, *three[1:2]] and (i == 1 or c[1, *three[:1]]) else 0.0
            if context:
                low3 = min(bound(3, three)[0] if low2 else 0.0, low2)
                p = (low3 + 2 * p) / (max(context, low3) + 2)
            out += math.log10(p)
        return round(out, 6)

    got = L.score(spark.createDataFrame(docs, "doc_id bigint, text string"), F.col("doc_id") % 5 != 1).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == {d: want(t) for d, t in docs}
