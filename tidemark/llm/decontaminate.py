"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, received, ship
from .text import ALNUM, Words, slices

#: Words of benchmark items in one automaton; more items make more automata, one broadcast each.
BLOCK_WORDS = 100_000

ADDED = T.StructType([
    T.StructField("__tm_words", T.LongType()),
    T.StructField("__tm_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("__tm_items", T.ArrayType(T.StringType())),
])


class Automaton:
    """Suffix automaton of word sequences. step() tracks the longest suffix of what was read that
    occurs in an item; found() tells which windows end there."""

    def __init__(self, items, window: int):
        """items: (id, list of words). A window is `window` consecutive words of an item, or all
        words of an item that has fewer."""
        self.window, self.ids = window, {}
        self.link, self.len, self.next = [-1], [0], [{}]
        items = [(k, [self.ids.setdefault(w, len(self.ids)) for w in words]) for k, words in items]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.long, self.short = {}, {}
        for key, words in items:
            s = n = 0
            for w in words:
                s, n = self.step(s, n, w)
                if n >= window:
                    self.long.setdefault(self._holder(s, window), set()).add(key)
            if 0 < len(words) < window:
                self.short.setdefault(self._holder(s, len(words)), {}).setdefault(len(words), set()).add(key)
        self.least = min((min(len(w), window) for _, w in items if w), default=0)
        self._ends: dict = {}

    def _extend(self, last: int, w: int) -> int:
        link, length, go = self.link, self.len, self.next
        if (q := go[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(link)
        link.append(0), length.append(length[last] + 1), go.append({})
        p = last
        while p != -1 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p != -1:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        link, length, go = self.link, self.len, self.next
        copy = len(link)
        link.append(link[q]), length.append(length[p] + 1), go.append(dict(go[q]))
        while p != -1 and go[p].get(w) == q:
            go[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _holder(self, s: int, n: int) -> int:
        """The state that holds the last n words of what state s has read."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def step(self, s: int, n: int, w: int):
        go = self.next
        while w not in go[s]:
            s = self.link[s]
            if s == -1:
                return 0, 0
            n = self.len[s]
        return go[s][w], n + 1

    def found(self, s: int, n: int):
        """(words, items) of each window that ends here; n is the length matched."""
        ends = self._ends.get(s)
        if ends is None:
            ends, at = [], s
            if self.len[s] >= self.window:
                ends.append((self.window, self.long[self._holder(s, self.window)]))
            while at > 0:
                ends += self.short.get(at, {}).items()
                at = self.link[at]
            self._ends[s] = ends
        return [e for e in ends if e[0] <= n]


def _scan(w: Words, automaton: Automaton, keys: np.ndarray, order: np.ndarray, words: list, seen: np.ndarray):
    """(row, first word, word after the last, items) of each window that occurs in some rows."""
    n, h = len(w.hashes), w.hashes
    if not n or not automaton.least:
        return
    ids = np.full(n, -1, np.int64)
    maybe = np.flatnonzero(seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    ids[maybe] = np.where(keys[at] == h[maybe], order[at], -1)
    known = np.concatenate(([False], ids >= 0, [False]))
    row = w.rows()
    cut = np.zeros(n + 1, bool)
    cut[w.first] = True  # runs end with their row
    begins = np.flatnonzero(known[1:-1] & (~known[:-2] | cut[:-1]))
    ends = np.flatnonzero(known[1:-1] & (~known[2:] | cut[1:])) + 1
    long = ends - begins >= automaton.least
    for a, b in zip(begins[long].tolist(), ends[long].tolist()):
        s = length = 0
        for i in range(a, b):
            k = int(ids[i])
            if w.word(i).lower() != words[k]:  # two words of one hash
                s = length = 0
                continue
            s, length = automaton.step(s, length, k)
            for size, items in automaton.found(s, length):
                yield int(row[i]), i + 1 - size, i + 1, items


def _annotate(shared, text_at: int, names: list, max_span: int | None = None):
    def run(batches):
        automaton = received(shared)
        words = list(automaton.ids)
        probe = Words(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))]), ALNUM) if words else None
        keys = probe.hashes if words else np.zeros(1, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        seen = np.zeros(1 << max(16, (4 * len(words)).bit_length()), bool)
        if words:
            seen[(keys & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        for batch in batches:
            text = batch.column(text_at)
            n = batch.num_rows
            counts, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
            for i, data, offsets in slices(text):
                w = Words(data, offsets, ALNUM)
                counts[i : i + len(offsets) - 1] = w.counts()
                for r, a, b, found in _scan(w, automaton, keys, order, words, seen):
                    a, b = a - int(w.first[r]), b - int(w.first[r])
                    spans[i + r].append((a, b))
                    items[i + r] |= found
            kept = {}
            for name in names:
                kept[name] = batch.column(batch.schema.get_field_index(name))
            if "__tm_spans" in batch.schema.names:  # what earlier blocks of items found
                for k, (s, t) in enumerate(zip(batch.column("__tm_spans").to_pylist(), batch.column("__tm_items").to_pylist())):
                    spans[k] += [(x["start"], x["end"]) for x in s]
                    items[k] |= set(t)
            spans = [_merge(s) for s in spans]
            if max_span is not None:
                long = [i for i, s in enumerate(spans) if any(b - a >= max_span for a, b in s)]
                if long:
                    rest = text.to_pylist()
                    for i in long:
                        rest[i] = _cut(rest[i], spans[i], max_span)
                    kept[names[text_at]] = pa.array(rest, text.type)
            yield pa.RecordBatch.from_arrays(
                [*kept.values(), pa.array(counts), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(t) for t in items], pa.list_(pa.string()))],
                [*kept, "__tm_words", "__tm_spans", "__tm_items"],
            )

    return run


def _merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS, max_span: int | None = None) -> DataFrame:
    """`docs` with __tm_words (words of the text), __tm_spans (hit words, merged, by position) and
    __tm_items (ids, as strings, of items with a window that occurs).

    The texts of one block of items, at most about `block_words` words plus one item, are collected
    and broadcast as one automaton; each further block is one more pass over the documents, so
    driver and workers hold one automaton whatever the size of the benchmark. There is no shuffle.
    With `max_span`, hit spans of at least so many words are cut from the texts; what is told of
    them is as before the cut.

    Null and empty texts have no words, no spans and no items. Items without words have no window.
    Rows of one item_id are one item; a null id counts as the empty string. Repeated documents are
    judged one by one. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).distinct()
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    names, scratch, out, last = docs.columns, Scratch(spark), docs, None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        rows = [(r["k"], _words(r["t"])) for r in sorted(part)]
        shared = ship(spark, Automaton(rows, window))
        schema = T.StructType([*docs.schema.fields, *ADDED.fields])
        out = out.mapInArrow(_annotate(shared, names.index(text), names, max_span if b + 1 == blocks else None), schema)
        if b + 1 < blocks:
            new = scratch.save(out)
            if last is not None:
                scratch.drop(last)
            out = last = new
    return out


def _words(text: str) -> list:
    data = text.encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
    return [w.word(i).lower() for i in range(len(w.hashes))]


def hits() -> F.Column:
    return F.aggregate("__tm_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(max_share: float = 0.05) -> F.Column:
    """Whether hit words make up at least `max_share` of the words, in whole numbers."""
    n, share = hits(), Fraction(str(max_share))
    return (n > 0) & (n * F.lit(share.denominator) >= F.col("__tm_words") * F.lit(share.numerator))


def decontaminate(docs: DataFrame, items: DataFrame, *, max_share: float = 0.05, max_span: int | None = None, text: str = "text", **more) -> DataFrame:
    """Documents, with their own columns, that are not contaminated.

    A document whose hit words make up `max_share` or more goes. With `max_span`, hit spans of at
    least so many words are cut from the texts of those that stay; null leaves texts as they are.
    """
    found = find(docs, items, text=text, max_span=max_span, **more).where(~contaminated(max_share))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut(text: str, spans, least: int) -> str:
    """The text without its spans of `least` words and more, from their first word to their last."""
    data = text.encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
    kept, at = [], 0
    for a, b in spans:
        if b - a >= least:
            kept.append(data[at : w.starts[a]])
            at = int(w.ends[b - 1])
    return b"".join([*kept, data[at:]]).decode()


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("__tm_words").alias("n_words"),
        hits().alias("n_hit"),
        F.size("__tm_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__tm_items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT k, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(p) WHERE len(w) > 0),
dw AS (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw) z, unnest(range(1, len(w) - n + 2)) t(p)),
hit AS MATERIALIZED (SELECT dw.rid, dw.p, dw.n, iw.k FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) t(q) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS sha FROM (SELECT DISTINCT rid, k FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
