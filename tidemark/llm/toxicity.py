"""Toxicity by a classifier whose score must not change when identity terms are swapped."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import ROWS, fold, sample
from .store import Scratch, received, ship
from .text import ALNUM, Words, mix, powers, slices

#: Groups of terms; each term is swapped for the next of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("homosexual", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european"), ("immigrants", "citizens"), ("immigrant", "citizen"), ("refugees", "residents"),
    ("disabled", "abled"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"), ("poor", "rich"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos"), ("negros", "blancos"), ("inmigrantes", "ciudadanos"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens"), ("noirs", "blancs"), ("immigrés", "citoyens"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen"), ("schwarze", "weiße"), ("ausländer", "bürger"),
)
#: Features that are kept at most, and toxic documents that must have a feature at least; a third
#: of the toxic documents, but 3, where that is less.
FEATURES, LEAST = 20_000, 8
#: Least likelihood gain (twice the log) of a feature, far beyond what chance gives the best of a
#: million (half the most that any feature can have, where that is less), and least share of toxic
#: documents among those that have it.
GAIN, PURE = 30.0, 0.4
#: Weights of the swap penalty and of the ridge.
SWAP, RIDGE = 100.0, 1e-3

_U = np.uint64
#: Kinds of features: whole words, pairs of words, and beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6, 7)
KINDS = 2 + len(BEGINNINGS)
_TAG = mix(np.arange(1, KINDS + 1, dtype=np.uint64))
#: Jaccard similarity of word pairs from which a labelled text is a copy; how many of its least
#: pair hashes estimate it; and seeds of the min-hashes that tell which texts are compared.
COPY, LOW = 0.8, 96
_SEEDS = mix(np.arange(101, 131, dtype=np.uint64))


def features(w: Words):
    """(hash, row) of every feature of each kind."""
    n, row = len(w.hashes), w.rows()
    if not n:
        return
    yield mix(w.hashes ^ _TAG[0]), row
    same = row[1:] == row[:-1]
    yield mix((w.hashes[:-1] * _U(0x9E3779B97F4A7C15) + w.hashes[1:])[same] ^ _TAG[1]), row[1:][same]
    up, down = powers(len(w.data))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ALNUM[w.data] * up[: len(w.data)], dtype=np.uint64)))
    for k, size in enumerate(BEGINNINGS, 2):
        long = w.ends - w.starts >= size
        at = w.starts[long]
        yield mix(mix((run[at + size] - run[at]) * down[at]) ^ _TAG[k]), row[long]


def _sketch(batches):
    """Label, hash of all words in order, and min-hashes and least hashes of each text's word pairs."""
    for batch in batches:
        whole, least = [], []
        for _, data, offsets in slices(batch.column(1)):
            w = Words(data, offsets, ALNUM)
            pair = mix(w.hashes[:-1] * _U(0x9E3779B97F4A7C15) + w.hashes[1:])
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                own = np.unique(pair[a : b - 1] if b - a > 1 else w.hashes[a:b])
                whole.append(hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest())
                least.append(np.concatenate((mix(own[None] ^ _SEEDS[:, None]).min(axis=1), own[:LOW])).tobytes() if len(own) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole, pa.binary()), pa.array(least, pa.binary())], ["row", "label", "whole", "least"])


def firsts(rows) -> list:
    """Of rows (row, label, whole, least), those that are no copies of an earlier kept one under
    the same label: the same words in the same order, or word pairs with an estimated Jaccard
    similarity of COPY or more. Only texts with an equal band, of three min-hashes, are compared,
    which leaves out less than 1 in 1000 of the pairs at COPY. Rows without words go."""
    kept, met, known = [], set(), {}
    for row, label, whole, least in rows:
        if not least or (label, whole) in met:
            continue
        met.add((label, whole))
        keys = [(label, i, least[24 * i : 24 * i + 24]) for i in range(10)]
        least = np.frombuffer(least, np.uint64)[len(_SEEDS) :]
        near = {id(o): o for k in keys for o in known.get(k, ())}.values()
        if any(alike(o, least) >= COPY for o in near):
            continue
        kept.append(row)
        for k in keys:
            known.setdefault(k, []).append(least)
    return kept


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, estimated from the least LOW hashes of each: the share of
    the least of both together that both have; exact for sets of no more."""
    both = np.union1d(a, b)[:LOW]
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def _present(batches):
    """Distinct features of each text, counted by label."""
    count: dict = {}
    for batch in batches:
        label = batch.column(0).to_numpy()
        for i, data, offsets in slices(batch.column(1)):
            parts = list(features(Words(data, offsets, ALNUM)))
            if not parts:
                continue
            f, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((r, f))
            f, r = f[order], r[order]
            new = np.concatenate(([True], (f[1:] != f[:-1]) | (r[1:] != r[:-1])))
            f, bad = f[new], (label[i + r[new]] == 1).astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(np.add.reduceat(bad, at)), pa.array(np.add.reduceat(1 - bad, at))], ["f", "bad", "good"])


class Model:
    """Weights by feature, sorted, and a bias."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float, bits: int = 22):
        order = np.argsort(names)
        self.names, self.weights, self.bias, self.bits = names[order], weights[order], bias, bits

    def ready(self):
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.names >> _U(64 - self.bits)).astype(np.int64)] = True
        return self

    def active(self, w: Words):
        """(row, index of feature, kind), each once, of the features of the model that rows have."""
        out = [(np.zeros(0, np.int64),) * 3]
        for kind, (f, r) in enumerate(features(w)):
            near = np.flatnonzero(self.seen[(f >> _U(64 - self.bits)).astype(np.int64)])
            if len(near) and len(self.names):
                at = np.minimum(np.searchsorted(self.names, f[near]), len(self.names) - 1)
                hit = self.names[at] == f[near]
                pair = np.unique(r[near][hit] * len(self.names) + at[hit])
                out.append((pair // len(self.names), pair % len(self.names), np.full(len(pair), kind)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def score(self, w: Words) -> np.ndarray:
        row, at, _ = self.active(w)
        z = self.bias + np.bincount(row, self.weights[at], minlength=len(w.first) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def swapped(text: str, identities=IDENTITIES) -> str:
    """The text with every identity term replaced by the next of its group."""
    to = {a: g[(i + 1) % len(g)] for g in identities for i, a in enumerate(g)}
    return re.sub(r"\w+", lambda m: to.get(m[0].lower(), m[0]), text)


def _active(model, identities):
    """Active features of labelled texts, as they are and with identity terms swapped."""

    def run(batches):
        m = received(model).ready()
        for batch in batches:
            rows, swap, kinds = [], [], []
            texts = batch.column(1).to_pylist()
            other = [swapped(t, identities) for t in texts]
            for values, to in ((pa.array(texts, pa.large_string()), rows), (pa.array(other, pa.large_string()), swap)):
                for _, data, offsets in slices(values):
                    w = Words(data, offsets, ALNUM)
                    row, at, kind = m.active(w)
                    by = np.argsort(row, kind="stable")
                    parts = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[:-1]
                    to += np.split(at[by], parts)
                    if to is rows:
                        kinds += np.split(kind[by], parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (rows, kinds, swap))], ["label", "own", "kind", "swap"])

    return run


def _sparse(rows):
    size = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), size), np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)])


def fit(label: np.ndarray, own: list, kind: list, swap: list, n: int, steps: int = 400):
    """Weights and bias of a logistic model of the rows' active features. Every toxic row also
    counts with the features of one kind alone, so that no kind rests on another. To the logistic
    loss come a ridge and, for each row, the squared change of its logit when it is swapped."""
    rows, y = list(own), list(label)
    for r, k, v in zip(own, kind, label):
        if v == 1:
            parts = [np.asarray(r)[np.asarray(k) == x] for x in range(KINDS)]
            rows += [p for p in parts if len(p)]
            y += [1] * sum(len(p) > 0 for p in parts)
    y = np.array(y, np.float64)
    r, c = _sparse(rows)
    a, b = _sparse(own), _sparse(swap)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    wb = np.zeros(n + 1)
    mean, var = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        w = wb[:-1]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], minlength=len(y)) + wb[-1], -40, 40)))
        g = weight * (p - y)
        change = (np.bincount(a[0], w[a[1]], minlength=len(own)) - np.bincount(b[0], w[b[1]], minlength=len(own))) * (2.0 * SWAP / max(1, len(own)))
        grad = np.append(np.bincount(c, g[r], minlength=n) + RIDGE * w / max(1, n) ** 0.5 + np.bincount(a[1], change[a[0]], minlength=n) - np.bincount(b[1], change[b[0]], minlength=n), g.sum()).astype(np.float64)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        wb = wb - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return wb[:-1], float(wb[-1])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target: str = "toxic", rows: int = ROWS, identities=IDENTITIES) -> Model:
    """A model of at most `rows` labelled documents outside the held-out fold; of copies among
    them, one. Its features are those that toxic documents have far more often than chance gives,
    FEATURES at most; only their counts and which documents have
    them come to the driver. With labels of one kind only every score is 0 or 1 accordingly, and
    0 without labels or where no feature tells toxic documents."""
    scratch = Scratch(docs.sparkSession)
    model = _trained(docs, labels, scratch, doc_id, text, target, rows, identities)
    scratch.keep()
    return model


def _trained(docs, labels, scratch, doc_id, text, target, rows, identities) -> Model:
    spark = docs.sparkSession
    told = sample(docs, labels, target, scratch, rows=rows, doc_id=doc_id, text=text)
    told = scratch.save(told.withColumn("row", F.monotonically_increasing_id()))
    sketches = told.select("row", "text", "label").mapInArrow(_sketch, "row bigint, label int, whole binary, least binary").orderBy("row").toArrow()
    unique = [(r,) for r in firsts(zip(*(c.to_pylist() for c in sketches.columns)))]
    if not unique:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    told = scratch.save(told.join(F.broadcast(spark.createDataFrame(unique, "u bigint")), F.col("row") == F.col("u")).select("label", "text"))
    bad, n = told.agg(F.count(F.when(F.col("label") == 1, 1)), F.count("*")).first()
    if bad in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if bad else -40.0)
    seen = told.mapInArrow(_present, "f bigint, bad bigint, good bigint").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= min(LEAST, max(3, -(-bad // 3))))
    both, rate = F.col("bad") + F.col("good"), bad / n
    least = min(GAIN, bad * math.log(1 / rate))
    # how much likelier the labels of the texts with the feature are at their own rate of toxic ones
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (both * F.lit(rate))) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * F.lit(1 - rate)))).otherwise(0.0))
    chosen = seen.withColumn("gain", gain).where((F.col("gain") >= least * (1 - 1e-9)) & (F.col("bad") >= PURE * both)).orderBy(F.desc("gain"), "f").limit(FEATURES).select("f").toArrow()
    if not len(chosen):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    names = np.sort(chosen["f"].to_numpy().view(np.uint64))
    shared = ship(spark, Model(names, np.zeros(len(names)), 0.0))
    rows_ = told.mapInArrow(_active(shared, identities), "label int, own array<bigint>, kind array<bigint>, swap array<bigint>").toArrow()
    # the order of rows is no part of the model
    cols = sorted(zip(*(rows_.column(c).to_pylist() for c in ("label", "own", "kind", "swap"))))
    weights, bias = fit(np.array([c[0] for c in cols]), *[[c[i] for c in cols] for i in (1, 2, 3)], len(names))
    return Model(names, weights, bias)


def _scores(model, kept: list, text_at: int):
    def run(batches):
        m = received(model).ready()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, data, offsets in slices(batch.column(text_at)):
                score[i : i + len(offsets) - 1] = m.score(Words(data, offsets, ALNUM))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(score)], [*(batch.schema.names[i] for i in kept), "__tm_toxic"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", keep=None, **more) -> DataFrame:
    """`docs` (or their columns `keep`) with __tm_toxic, from 0 to 1, from the whole text alone.

    Null and empty texts have the score of a text without any feature of the model. Equal texts
    have equal scores. An empty table gives no rows."""
    model = ship(docs.sparkSession, train(docs, labels, text=text, **more))
    keep = list(docs.columns if keep is None else keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__tm_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__tm_toxic", T.DoubleType())])
    return rows.mapInArrow(_scores(model, list(range(len(keep))), len(keep)), schema)


def civil(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The documents that score under 0.5, with their own columns."""
    return score(docs, labels, **more).where(F.col("__tm_toxic") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("__tm_toxic").alias("score"), (F.col("__tm_toxic") >= 0.5).cast("int").alias("predicted"))
