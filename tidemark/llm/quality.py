"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import ROWS, fold, sample
from .store import Scratch, received, ship
from .text import mix, powers, slices, sums, uniform

#: Buckets that n-grams are hashed into.
BUCKETS = 1 << 16
#: Standard errors that the share of good documents among the labels is taken higher by.
ERRORS = 2.0

_U = np.uint64
_KIND = np.ones(256, np.uint8)  # 0: white space, 1: letters, digits and non-ASCII, 2: other ASCII
_KIND[list(range(0x80))] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def grams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the uni- and bigrams of each row and where rows begin among them.

    Tokens are runs of letters and digits and runs of punctuation."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:-1])
    starts = starts[kind[starts] != 0]
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), first
    up, down = powers(len(data))
    value = np.where(kind != 0, data.astype(np.uint64) + _U(1), _U(0)) * up[: len(data)]
    one = mix(np.add.reduceat(value, starts) * down[starts])
    two = mix(one[:-1] * _U(0x9E3779B97F4A7C15) + one[1:])
    out = np.full(2 * len(one), -1, np.int64)
    out[0::2] = (one >> _U(48)).astype(np.int64) % BUCKETS
    out[3::2] = (two >> _U(48)).astype(np.int64) % BUCKETS
    begins = first[:-1][np.diff(first) > 0]
    out[2 * begins + 1] = -1  # no bigram over a row's edge
    kept = out >= 0
    return out[kept], np.concatenate(([0], np.cumsum(kept)))[2 * first]


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            total += np.bincount(grams(data, offsets)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is in all of `texts` (one column); tasks add up before they send."""
    found = texts.mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.float64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of the target's over the raw text's probability of each bucket; 0 without any target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS))
    return p(target) - p(raw)


def weigh(values: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Log importance ratio of each row and its number of n-grams."""
    at, first = grams(data, offsets)
    return sums(values[at], first), np.diff(first)


def good_share(good: int, told: int, errors: float = ERRORS) -> float:
    """Share of good documents among the labelled, higher by some standard errors, so that chance
    in the labels doesn't reject good documents; 1 without labels."""
    p = good / told if told else 1.0
    return min(1.0, p + errors * math.sqrt(p * (1 - p) / max(told, 1)))


def _keys(values, kept: list, text_at: int, id_at: int):
    def run(batches):
        table = received(values)
        for batch in batches:
            ratio, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, data, offsets in slices(batch.column(text_at)):
                ratio[i : i + len(offsets) - 1], size[i : i + len(offsets) - 1] = weigh(table, data, offsets)
            noise = -np.log(-np.log(uniform(batch.column(id_at).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(ratio), pa.array(size), pa.array(ratio + noise)], [*(batch.schema.names[i] for i in kept), "__tm_ratio", "__tm_grams", "__tm_key"])

    return run


def _weighed(docs: DataFrame, values, doc_id: str, text: str, keep: list) -> DataFrame:
    """`keep` columns of docs with log ratio, n-grams and perturbed key."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__tm_text"), F.xxhash64(F.lit("gumbel"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("__tm_hash"))
    n = len(keep)
    added = [T.StructField("__tm_ratio", T.DoubleType()), T.StructField("__tm_grams", T.LongType()), T.StructField("__tm_key", T.DoubleType())]
    return rows.mapInArrow(_keys(values, list(range(n)), n, n + 1), T.StructType([*rows.schema.fields[:n], *added]))


def nth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, exactly, by counting ever finer ranges."""
    if k <= 0:
        return float("inf")
    low, high, total = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= total:
        return float("-inf")
    while True:
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        step = (high - low) / 1024
        bins = sorted(inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(step or 1.0)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        if b["lo"] == b["hi"]:
            return b["lo"]
        low, high = b["lo"], b["hi"]


def resample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target: str = "quality", rows: int = ROWS, share: float | None = None, keep=None) -> DataFrame:
    """`docs` (or their columns `keep`) with __tm_ratio, __tm_grams, __tm_key and __tm_kept.

    The target model is of the documents labelled 1, from a sample of at most `rows` labels; the
    raw model is of all documents. Both count hashed uni- and bigrams; __tm_ratio, the log ratio of
    a whole text's probabilities, is its log importance weight, and __tm_key that weight with
    Gumbel noise of scale 1. The documents with the k largest keys are a sample without replacement
    by importance: k is `share` of the documents, or else the share of good ones among the labels,
    by ERRORS standard errors higher. The k-th key is found by distributed counting, and only that
    number is needed to decide: a document is kept if its key reaches it. The noise is a hash of id
    and text, so reruns agree and rows that repeat both are kept or rejected together; nothing is
    shuffled but counts and labelled texts.

    Null and empty texts have no n-grams and weight 0, as has every text where no label is 1; with
    no labels, or good ones only, all are kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    learned = sample(docs, labels, target, scratch, rows=rows, doc_id=doc_id, text=text)
    told, good = learned.agg(F.count("*"), F.count(F.when(F.col("label") == 1, 1))).first()
    share = good_share(good, told) if share is None else share
    values = ship(docs.sparkSession, ratios(counts(learned.where("label = 1").select("text")), counts(docs.select(F.col(f"`{text}`").alias("text")))))
    scored = _weighed(docs, values, doc_id, text, list(docs.columns if keep is None else keep))
    keys = scratch.save(scored.select("__tm_key"))
    last = nth_largest(keys, "__tm_key", round(share * keys.count()))
    scratch.keep()
    return scored.withColumn("__tm_kept", F.col("__tm_key") >= F.lit(last))


def good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The documents that resampling keeps, with their own columns."""
    return resample(docs, labels, **more).where("__tm_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return out.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("__tm_grams").alias("n_grams"),
        F.col("__tm_ratio").alias("log_ratio"), F.col("__tm_key").alias("score"), F.col("__tm_kept").alias("kept"),
    )
