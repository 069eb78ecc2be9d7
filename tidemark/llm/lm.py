"""Language-model scores from a log-frequency Bloom filter of n-gram counts, held in shards."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, received, ship
from .text import SPACED, Words, mix, slices, sums

#: Longest n-grams that are counted.
ORDER = 3
#: Levels of a count per doubling, by order: a token's own count is wanted finer.
STEPS = {1: 4, 2: 2, 3: 2}
#: n-grams that are asked of one shard, about, at most.
PROBED = 2_000_000
#: Bits of the filter for each member. A lookup probes four bits in each of two words.
BITS_EACH = 14
#: n-grams that one task adds up at a time, on either side of the shuffle.
AT_ONCE = 1_000_000
#: Bytes of text whose n-grams are looked up at a time.
PACK_BYTES = 8 << 20
#: Tokens with at least this share of all training tokens have their exact count broadcast, so
#: there are at most 1 / HEAVY of them.
HEAVY = 1 / 2_000_000
#: Weight of the shorter context, as a count, by order of the n-gram.
BACKOFF = {2: 100.0, 3: 2.0}

_U = np.uint64
_START, _END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_TAG = {n: mix(np.array([n * 0x9E3779B9], np.uint64))[0] for n in (1, 2, 3)}


def tokens(w: Words):
    """Token hashes of some rows, each row's words and one end; first[i]:first[i+1] are row i's."""
    rows = len(w.first) - 1
    first = w.first + np.arange(rows + 1)
    t = np.full(int(first[-1]), _END, np.uint64)
    t[np.arange(len(w.hashes)) + w.rows()] = w.hashes
    return t, first


def ngrams(t: np.ndarray, first: np.ndarray):
    """Hashes of the n-grams that end at each token, by order; rows begin after start marks."""
    one = mix(t ^ _TAG[1])
    back1, back2 = np.empty_like(t), np.empty_like(t)
    back1[1:], back2[2:] = t[:-1], t[:-2]
    begin = first[:-1]
    back1[begin] = back2[begin] = _START
    second = begin[np.diff(first) > 1] + 1
    back2[second] = _START
    two = mix((mix(back1) + t * _U(0x9E3779B97F4A7C15)) ^ _TAG[2])
    three = mix((mix(mix(back2) + back1 * _U(0x9E3779B97F4A7C15)) + t * _U(0xC2B2AE3D27D4EB4F)) ^ _TAG[3])
    return {1: one, 2: two, 3: three}, back1


def _counted(h: np.ndarray, n: np.ndarray | None = None):
    """Distinct hashes, ascending, and how often each is there."""
    order = np.argsort(h) if n is not None else None
    h = np.sort(h) if order is None else h[order]
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h))) if n is None else np.add.reduceat(n[order], at)


def level(count: np.ndarray, order: int) -> np.ndarray:
    """1 and more for counts of 1 and more, growing with the logarithm."""
    return 1 + np.floor(np.log2(np.maximum(count, 1)) * STEPS[order] + 1e-9).astype(np.int64)


def bounds(level: np.ndarray, order: int):
    """Least and most whole counts of each level; 0 for level 0."""
    low = np.ceil(2.0 ** ((level - 1) / STEPS[order]) - 1e-6)
    high = np.maximum(low, np.ceil(2.0 ** (level / STEPS[order]) - 1e-6) - 1)
    return np.where(level > 0, low, 0.0), np.where(level > 0, high, 0.0)


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram, by the upper half of its hash, before the lower half, which names
    it there: in the order of these keys n-grams are asked for and answered."""
    return ((h >> _U(32)) % _U(shards)) << _U(32) | (h & _U(0xFFFFFFFF))


def _pack(key: np.ndarray, n: np.ndarray, shards: int, order: int):
    """Rows (shard, order, names, counts) of ascending keys. Names are spelled out byte by byte, the
    lowest bytes of all first, so that ascending upper bytes compress; of counts, those of 255 and
    more are told apart."""
    ends = np.searchsorted(key, np.arange(shards + 1, dtype=np.uint64) << _U(32))
    low, few = key.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    many = few == 255
    for s in np.flatnonzero(np.diff(ends)).tolist():
        a, b = ends[s], ends[s + 1]
        yield s, order, low[a:b].view(np.uint8).reshape(-1, 4).T.tobytes(), few[a:b].tobytes(), n[a:b][many[a:b]].astype(np.int64).tobytes()


def _unpack(names: bytes, few: bytes, many: bytes):
    h = np.ascontiguousarray(np.frombuffer(names, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
    n = np.frombuffer(few, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(many, np.int64)
    return h, n


_PACKED = pa.schema([("shard", pa.int32()), ("ord", pa.int32()), ("h", pa.binary()), ("few", pa.binary()), ("many", pa.binary())])


def _probe(h: np.ndarray, lv: int, words: np.ndarray):
    """The two words of a filter of `words` words that hold member (h, lv), and its bits in each."""
    x = mix(h + _U(lv * 0x9E3779B97F4A7C15 % (1 << 64)))
    y = x * _U(0xD6E8FEB86659FD93)
    y ^= y >> _U(29)
    for half, shift in ((x & _U(0xFFFFFFFF), 0), (x >> _U(32), 24)):
        bits = np.zeros(len(h), np.uint64)
        for i in range(shift, shift + 24, 6):
            bits |= _U(1) << ((y >> _U(i)) & _U(63))
        yield ((half * words) >> _U(32)).astype(np.int64), bits


class Filter:
    """A log-frequency Bloom filter: an n-gram of level j is a member as (n-gram, 1), ... (n-gram,
    j), so that its quantised count comes from repeated membership probes. Its size follows from
    its members."""

    def __init__(self, h: np.ndarray, levels: np.ndarray):
        h, levels = h[levels > 0], levels[levels > 0]
        self.words = _U(max(1, -(-int(levels.sum()) * BITS_EACH // 64)))
        self.on = np.zeros(int(self.words), np.uint64)
        for j in range(1, int(levels.max(initial=0)) + 1):
            for at, bits in _probe(h[levels >= j], j, self.words):
                np.bitwise_or.at(self.on, at, bits)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 if it isn't a member. A false member is at 1 in about 800, and
        one level more than is true at as few."""
        out, alive, j = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        while len(alive):
            j += 1
            hit = np.ones(len(alive), bool)
            for at, bits in _probe(h[alive], j, self.words):
                hit &= self.on[at] & bits == bits
            alive = alive[hit]
            out[alive] = j
        return out


def log10(levels, starts: float, first: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each token after the two before it: a token's share of all tokens, as
    in the base score; then, at each longer context that was seen, the n-gram's count and the
    shorter context's probability times BACKOFF, over the context's count and BACKOFF. `levels` has
    the level of every n-gram by order. An n-gram counts the least of its level, a context the most
    of its own, so that the probabilities of all tokens after a context add up to 1 at most."""
    low, high = bounds(levels[1], 1)
    p = (low + 0.5) / (total + 0.5 * (distinct + 1))
    context = np.empty_like(high)
    context[1:] = high[:-1]
    context[first[:-1]] = starts
    low2, high2 = bounds(np.where((low > 0) & (context > 0), levels[2], 0), 2)
    low2 = np.minimum(low2, low)
    p = np.where(context > 0, (low2 + BACKOFF[2] * p) / (np.maximum(context, low2) + BACKOFF[2]), p)
    context = np.zeros_like(high)
    context[1:] = high2[:-1]
    context[first[:-1]] = 0
    low3 = np.minimum(bounds(np.where((low2 > 0) & (context > 0), levels[3], 0), 3)[0], low2)
    p = np.where(context > 0, (low3 + BACKOFF[3] * p) / (np.maximum(context, low3) + BACKOFF[3]), p)
    return np.log10(p)


def exact_base(exact, t: np.ndarray, total: int, distinct: int):
    """Base score of the tokens whose counts are in `exact` (hashes, counts), 0 for others; and which those are."""
    at = np.minimum(np.searchsorted(exact[0], t), len(exact[0]) - 1)
    hit = exact[0][at] == t
    return np.where(hit, np.log10((exact[1][at] + 0.5) / (total + 0.5 * (distinct + 1))), 0.0), hit


def _vocabulary(batches):
    """Hashes of the tokens of the training texts that a task reads, counted."""
    held, size = [], 0

    def flush():
        h, n = _counted(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "c"])

    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            held.append(tokens(Words(data, offsets, SPACED))[0])
            size += len(held[-1])
            if size >= AT_ONCE:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


_ASKED = pa.schema([("pack", pa.int64()), *_PACKED])


def _ask(shards: int):
    """The distinct n-grams of a pack of texts by shard, with their counts in its training texts,
    0 for those that only held-out texts have."""

    def run(table: pa.Table) -> pa.Table:
        held = {n: [] for n in range(1, ORDER + 1)}
        flags = []
        text, out = table.column("text").combine_chunks(), table.column("held_out").to_numpy()
        for i, data, offsets in slices(text):
            t, first = tokens(Words(data, offsets, SPACED))
            flags.append(np.repeat(~out[i : i + len(first) - 1], np.diff(first)))
            for n, h in ngrams(t, first)[0].items():
                held[n].append(h)
        learn = np.concatenate(flags).astype(np.int64)
        rows = [r for n, parts in held.items() for r in _pack(*_counted(_key(np.concatenate(parts), shards), learn), shards, n)]
        pack = table.column("pack")[0].as_py()
        return pa.table([pa.array([pack] * len(rows), pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED))], schema=_ASKED)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For one shard, with all counts of its n-grams: their log-frequency Bloom filter, and from it,
    by probes, the level of each n-gram of each request, in the order of the request."""
    order, levels = np.array(table.column("ord").to_pylist()), [b""] * table.num_rows
    for n in np.unique(order).tolist():
        rows = np.flatnonzero(order == n).tolist()
        parts = [_unpack(*(table.column(c)[i].as_py() for c in ("h", "few", "many"))) for i in rows]
        h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.zeros(len(h), np.int64)
        np.add.at(count, where, np.concatenate([p[1] for p in parts]))
        all_ = Filter(h := h.astype(np.uint64), np.where(count > 0, level(count, n), 0)).levels(h).astype(np.uint8)[where]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
        for i, a, b in zip(rows, ends, ends[1:]):
            levels[i] = all_[a:b].tobytes()
    return pa.table({"pack": table.column("pack"), "shard": table.column("shard"), "ord": table.column("ord"), "levels": pa.array(levels, pa.binary())})


def _told(h: np.ndarray, shards: int, answers: list):
    """Levels of the n-grams h of a pack, from the answers by ascending shard to what _ask sent."""
    own, where = np.unique(_key(h, shards), return_inverse=True)
    levels = np.frombuffer(b"".join(answers), np.uint8)
    assert len(levels) == len(own)
    return levels[where].astype(np.int64)


def _score(shards: int, shared, starts: float, total: int, distinct: int):
    """Scores of a pack of texts by the answers to its n-grams; of the base score, the part of the
    tokens whose counts are broadcast; and the other tokens, with how often each is in the text."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        exact = received(shared)
        parts = {n: [] for n in range(1, ORDER + 1)}
        for _, n, x in sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "ord", "levels")))):
            parts[n].append(x)
        pieces = [tokens(Words(data, offsets, SPACED)) for _, data, offsets in slices(table.column("text").combine_chunks())]
        grams = [ngrams(*x)[0] for x in pieces]
        levels = {n: _told(np.concatenate([g[n] for g in grams]), shards, x) for n, x in parts.items()}
        out = {k: [] for k in ("tokens", "score", "base", "known", "rare", "times")}
        done = 0
        for t, first in pieces:
            p = log10({n: x[done : done + len(t)] for n, x in levels.items()}, starts, first, total, distinct)
            base, hit = exact_base(exact, t, total, distinct)
            done += len(t)
            out["tokens"].append(np.diff(first))
            out["score"].append(sums(p, first))
            out["base"].append(sums(base, first))
            out["known"].append(sums(hit, first).astype(np.int64))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                own, times = np.unique(t[a:b][~hit[a:b]], return_counts=True)
                out["rare"].append(own.view(np.int64))
                out["times"].append(times.astype(np.int32))
        cat = lambda k, t: pa.array(np.concatenate(out[k]), t)
        return pa.table(
            [table.column("doc_id"), table.column("held_out"), cat("tokens", pa.int64()), cat("score", pa.float64()), cat("base", pa.float64()), cat("known", pa.int64()), pa.array(out["rare"], pa.list_(pa.int64())), pa.array(out["times"], pa.list_(pa.int32()))],
            ["doc_id", "held_out", "n_tokens", "score", "base", "known", "rare", "times"],
        )

    return run


def score(docs: DataFrame, train: F.Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document,
    by a model of the documents for which `train` holds.

    Texts are lower-cased (A-Z) and split into words [^\\x20\\x09-\\x0D]+, then one end. All
    n-grams up to ORDER of all training texts are counted, by hashes; the model is a log-frequency
    Bloom filter of the logarithms of their counts, and the score comes from probes of it alone. It
    grows with the texts, so it isn't broadcast whole but held in shards, as many as hold about
    PROBED n-grams each; none is left out and none comes to the driver: texts are dealt to packs,
    each pack sends its distinct n-grams once to the shards that have their filters, and gets the
    levels that probes find back, a byte each.
    The base score needs exact counts: those of frequent tokens are broadcast, at most 1 / HEAVY
    of them; the others meet their documents in a join, once for each document and token.

    Null and empty texts are one end. With no training text all counts are 0 and every token has
    probability 1. Repeated rows are scored one by one and, where trained on, count as often.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (~train).alias("held_out"), F.col(text).alias("text"))
    learn = rows.where("not held_out").select("text")
    words = scratch.save(learn.mapInArrow(_vocabulary, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    told = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == int(_END.astype(np.int64)), F.col("c"))).alias("ends")).first()
    total, distinct, ends = told["n"] or 0, told["v"], told["ends"] or 0
    least = max(1.0, total * HEAVY)
    heavy = words.where(F.col("c") >= least).orderBy(F.col("h") < 0, "h").toArrow()
    hashes, counts = heavy["h"].to_numpy().view(np.uint64), heavy["c"].to_numpy().astype(np.float64)
    exact = ship(spark, (hashes, counts) if total else (np.zeros(1, np.uint64), np.zeros(1)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs, shards = max(12, -(-size // PACK_BYTES)), max(12, -(-size // 4 * ORDER // PROBED))
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)))
    asked = dealt.groupBy("pack").applyInArrow(_ask(shards), "pack bigint, shard int, ord int, h binary, few binary, many binary")
    told = scratch.save(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_answer, "pack bigint, shard int, ord int, levels binary"))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, score double, base double, known bigint, rare array<bigint>, times array<int>"
    schema = schema.replace("bigint", rows.schema["doc_id"].dataType.simpleString(), 1)
    for _ in range(2):  # what the first call lets go of, the second finds unused
        scratch.free()
        time.sleep(1)
    scored = dealt.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(_score(shards, exact, float(ends), total, distinct), schema)
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()))
    scratch.keep(scored, words)
    light = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    light = light.join(words.where(F.col("c") < F.lit(least)), F.col("token") == F.col("h"), "left")
    size = float(total + 0.5 * (distinct + 1))
    part = F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(size))
    light = light.groupBy("row").agg(F.sum(part).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    out = scored.drop("rare", "times").join(light.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True)))
