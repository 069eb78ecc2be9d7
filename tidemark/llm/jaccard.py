"""Size-aware heavy-light Jaccard join of the word-shingle sets of documents."""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import Scratch, received, ship
from .text import SPACED, Words, mix, slices

#: Slots (as a power of two) of the table of how frequent shingles are; it only orders shingles.
SKETCH_BITS = 22
#: Meetings that make a slot frequent, and frequent slots that are broadcast at most, the foremost.
OFTEN, LISTED = 16, 1 << 19
#: Sets up to which a list is joined with itself; longer lists are compared in blocks of sets.
LIST, BLOCK = 32, 2048
#: Largest set that may meet under subsets, whatever the costs.
MOST = 16
#: Sets of a list from which on it is dealt to several tasks for its hubs.
HOT = 4096
#: Shingles that a task sorts at a time.
AT_ONCE = 1_000_000
#: Rows of a key list (16 bytes each) up to which it is broadcast; longer lists are shuffled.
BROADCAST_ROWS = 500_000
#: What else the sketch counts; sizes are slots -1 to -MOST.
_ALL, _DISTINCT = -1000, -1001
_PLACES = mix(np.arange(1, 65, dtype=np.uint64))


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(w: Words, k: int):
    """The sorted distinct k-word shingles of each row; all words as one where there are fewer."""
    h, n = w.hashes, len(w.hashes)
    every = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        every[: n - j] += h[j:] * _PLACES[j % 64]
    every = mix(every)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix((h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield every[:0]


def boundary(percent: int, sizes: dict, length: float, most: int = MOST) -> int:
    """Largest size of the sets that meet under subsets: of all boundaries up to `most`, the one of
    least cost over the sets that there are, `sizes` (size: how many).

    A set under subsets costs one row for each subset of each overlap that a partner of any size
    asks for; a set in lists one row for each of its rarest shingles and, in each, a comparison with
    the others of the list, `length` of them on average."""
    under = {n: sum(comb(n, overlap(n, m, percent)) for m in range(-(-percent * n // 100), 100 * n // percent + 1)) for n in range(1, most + 1)}
    within = {n: (n - -(-percent * n // 100) + 1) * (1 + length) for n in range(1, most + 1)}
    cost = [sum(sizes.get(n, 0) * (under[n] if n <= light else within[n]) for n in under) for light in range(most + 1)]
    return cost.index(min(cost))


def _subsets(s: np.ndarray, percent: int, light: int):
    n = len(s)
    for m in range(-(-percent * n // 100), min(light, 100 * n // percent) + 1):
        size, tag = overlap(n, m, percent), np.uint64(min(n, m) * 1000 + max(n, m))
        for c in combinations(s.tolist(), size):
            yield mix(mix(np.array(c, np.uint64)).sum(dtype=np.uint64, keepdims=True) + mix(np.array([tag])))[0]


def bitmap(s: np.ndarray) -> bytes:
    """The parity of how many members fall on each of at least twice as many bits. Two bitmaps
    differ in no more bits than two sets differ in members."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    on = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which bitmaps differ, the larger one folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketch(k: int, bits: int):
    """How often a task meets shingles that it meets again, by slot; as slot -n, how many sets of
    size n up to MOST it has; and as slots _ALL and _DISTINCT, shingles and different ones."""

    def run(batches):
        held, size, sizes = [], 0, np.zeros(MOST + 1, np.int64)

        def flush():
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
            n = np.diff(np.append(at, len(h)))
            slot = (h[at[n > 1]] >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[: len(slot)]
            total = np.add.reduceat(n[n > 1], first) if len(first) else np.zeros(0, np.int64)
            slot = np.concatenate((slot[first], -np.arange(1, MOST + 1), [_ALL, _DISTINCT]))
            total = np.concatenate((total, sizes[1:], [len(h), len(at)]))
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total, pa.int64())], ["slot", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                for s in shingle_sets(Words(data, offsets, SPACED), k):
                    held.append(s)
                    size += len(s)
                    if len(s) <= MOST:
                        sizes[len(s)] += 1
                if size >= AT_ONCE:
                    yield flush()
                    held, size = [], 0
                    sizes[:] = 0
        if size:
            yield flush()

    return run


def _sets(k: int, percent: int, light: int, bits: int, levels):
    """doc_id, text key, size, signature of the set, and (for the first of equal sets that a task
    sees) the tokens under which it meets its partners."""

    def run(batches):
        level, met = np.zeros(1 << bits, np.uint8), set()
        slot, value = received(levels)
        level[slot] = value
        for batch in batches:
            sizes, signs, tokens, maps = [], [], [], []
            for _, data, offsets in slices(batch.column(2)):
                for s in shingle_sets(Words(data, offsets, SPACED), k):
                    n = len(s)
                    sizes.append(n)
                    sign = int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(n)).astype(np.int64)) if n else None
                    signs.append(sign)
                    if not n or sign in met:
                        tokens.append(None)
                        maps.append(None)
                        continue
                    met.add(sign)
                    own = []
                    low = -(-percent * n // 100)
                    if n > light or 100 * n >= percent * (light + 1):
                        rare = s[np.argsort(level[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")] if len(slot) else s
                        own.append(rare[: n - low + 1])
                    if n <= light:
                        own.append(np.array(list(_subsets(s, percent, light)), np.uint64))
                    tokens.append(np.concatenate(own).view(np.int64))
                    maps.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                ["doc_id", "tk", "n", "sign", "tokens", "bits"],
            )

    return run


def _blobs(k: int):
    def run(batches):
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                signs, blobs = [], []
                for s in shingle_sets(Words(data, offsets, SPACED), k):
                    signs.append(int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)))
                    blobs.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(blobs, pa.binary())], ["sign", "blob"])

    return run


def _plausible(percent: int):
    """Pairs that may link as far as sizes and bitmaps tell; none that links is left out."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = [i for i in range(len(n)) if (n[i] + m[i] - differing(x[i], y[i])) // 2 >= overlap(n[i], m[i], percent)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _halves(table: pa.Table):
    """Rows of a block by position, and the positions of its two sides."""
    own = table.column("own").to_numpy()
    return np.flatnonzero(own == table.column("a")[0].as_py()), np.flatnonzero(own == table.column("b")[0].as_py())


def _hoped(n: np.ndarray, maps: list, left: np.ndarray, right: np.ndarray, percent: int):
    """(i, positions on the right that may link with i, as far as sizes and bitmaps tell)."""
    size = np.array([len(m) for m in maps])
    table = {}

    def at(rows, length):
        key = (id(rows), length)
        if key not in table:
            keep = rows[(size[rows] == length) | (size[rows] == 2 * length)]
            flat = [np.frombuffer(maps[r], np.uint8) for r in keep]
            flat = [f if len(f) == length else f[:length] ^ f[length:] for f in flat]
            table[key] = keep, np.array(flat, np.uint8).reshape(len(keep), length).view(np.uint64)
        return table[key]

    for i in left.tolist():
        found = [np.zeros(0, np.int64)]
        for length in {size[i], size[i] // 2}:
            if length < 8:
                continue
            rows, bits = at(right, length)
            own = np.frombuffer(maps[i], np.uint8)
            own = (own if len(own) == length else own[:length] ^ own[length:]).view(np.uint64)
            # sets of one size at their own length, others at the shorter one's
            rows, bits = (rows, bits) if length == size[i] else (rows[size[rows] == length], bits[size[rows] == length])
            differ = np.bitwise_count(bits ^ own).sum(axis=1, dtype=np.int64)
            both = n[i] + n[rows]
            found.append(rows[(both - differ) // 2 >= -(-percent * both // (100 + percent))])
        yield i, np.concatenate(found)


def _hopeful(percent: int):
    """Members of a block that may link with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        left, right = _halves(table)
        comp, keep = table.column("comp").to_numpy(), np.zeros(table.num_rows, bool)
        for i, near in _hoped(table.column("n").to_numpy(), table.column("bits").to_pylist(), left, right, percent):
            near = near[comp[near] != comp[i]]
            if len(near):
                keep[i] = keep[near] = True
        return table.select(["token", "a", "b", "own", "sign", "comp"]).filter(pa.array(keep))

    return run


def _joining(percent: int):
    """Links between components within a block, as few as join what links join."""

    def run(table: pa.Table) -> pa.Table:
        left, right = _halves(table)
        sign, comp = table.column("sign").to_numpy(), table.column("comp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("blob").to_pylist()]
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, near in _hoped(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], left, right, percent):
            for j in near.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[max(x, y)] = min(x, y)
                        out.append((sign[i], sign[j]))
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast where a count shows that it has few rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, tk, n_shingles, component_id), one row per document, tk being a hash of the text.

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the smallest doc_id that links reach. Equal sets are one vertex throughout, so
    copies cost no pairs. Sets up to boundary(), which follows from the sizes and shingles that
    there are, meet under subsets of a fixed size, larger ones in inverted lists of their rarest shingles (prefix filter; the order may be any, so an inexact
    table of frequent shingles gives it). In each list, sets of like size first meet one of their
    number only, and what that links is a component; then only sets of different components that
    share a list meet, those of long lists in blocks that list no pairs. So groups of near copies
    cost no pairs among themselves, and no link between components is missed. Of all that meet, parity bitmaps rule out pairs that differ too
    much; the others are compared in full, on sets built from the texts.

    Null and empty texts, and those without words, have no shingles and are alone. Null ids count
    only where nothing in the component has an id. Repeated rows are copies. Empty: no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tk"), F.col(text).alias("text"))
    seen = scratch.save(rows.select("text").mapInArrow(_sketch(k, sketch_bits), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where((F.col("slot") < 0) | (F.col("n") >= OFTEN)))
    told = {r["slot"]: r["n"] for r in seen.where("slot < 0").collect()}  # some MOST + 2 rows
    often = seen.where("slot >= 0").orderBy(F.desc("n"), "slot").limit(LISTED).select("slot", "n").toArrow()
    light = boundary(percent, {-x: n for x, n in told.items()}, told.get(_ALL, 0) / max(1, told.get(_DISTINCT, 0)))
    slot, number = often["slot"].to_numpy(), often["n"].to_numpy()
    levels = ship(spark, (slot, np.floor(np.log2(np.maximum(number, 1))).astype(np.uint8)))
    sets = scratch.save(rows.mapInArrow(_sets(k, percent, light, sketch_bits, levels), "doc_id bigint, tk bigint, n bigint, sign bigint, tokens array<bigint>, bits binary"))
    own = scratch.save(sets.where("sign is not null").groupBy("sign").agg(F.min("doc_id").alias("least"), F.min("tk").alias("tk"), F.max("n").alias("n")))

    c = F.col
    met = sets.where("tokens is not null").select("sign", "n", F.posexplode("tokens").alias("pos", "token"))
    met = met.withColumn("pos", F.when(c("n") <= light, F.lit(0)).otherwise(c("pos")))
    met = met.withColumn("band", F.floor(F.log(c("n").cast("double")) / F.lit(float(np.log(100 / percent)))))
    # lists that the sketch tells to be long are dealt to tasks by set; each part has hubs of its own
    hot = np.flatnonzero(number >= HOT)
    parts = F.lit(1)
    if len(hot):
        long = spark.createDataFrame(pa.table({"slot": pa.array(slot[hot], pa.int32()), "parts": pa.array(-(-number[hot] // HOT), pa.int32())}))
        met = met.join(small(long), F.shiftrightunsigned("token", 64 - sketch_bits) == c("slot"), "left")
        parts = F.coalesce("parts", F.lit(1))
    met = met.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("sign"), parts)})
    token, like = Window.partitionBy("token", "part"), Window.partitionBy("token", "part", "band")
    met = met.withColumn("hub", F.min(F.struct("sign", "n", "pos")).over(like)).withColumns({"low": F.min("sign").over(token), "high": F.max("sign").over(token)})
    met = scratch.save(met.where("low < high or parts > 1").select("token", "sign", "n", "pos", "band", "hub", "parts"))

    def possible(n, m, i, j):
        need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
        return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(1) + F.least(n - i - 1, m - j - 1) >= need)

    stars = met.where((c("sign") != c("hub.sign")) & possible(c("n"), c("hub.n"), c("pos"), c("hub.pos")))
    stars = stars.select("sign", c("hub.sign").alias("other"))
    if len(hot):  # the hubs of the parts of a list meet the least of them
        hubs = met.where("parts > 1").select("token", "band", "hub").distinct()
        top = hubs.groupBy(c("token").alias("tt"), c("band").alias("tb")).agg(F.min("hub").alias("top"))
        hubs = hubs.join(top, (c("token") == c("tt")) & (c("band") == c("tb"))).where((c("hub.sign") != c("top.sign")) & possible(c("hub.n"), c("top.n"), c("hub.pos"), c("top.pos")))
        stars = stars.unionByName(hubs.select(c("hub.sign").alias("sign"), c("top.sign").alias("other")))
    stars = scratch.save(stars.distinct())

    def maps_of(signs: DataFrame) -> DataFrame:
        found = sets.where("bits is not null").select("sign", "n", "bits").join(small(signs), c("sign") == c("key"), "left_semi")
        return scratch.save(found.dropDuplicates(["sign"]))

    def blobs_of(signs: DataFrame) -> DataFrame:
        need = signs.join(own, c("key") == c("sign")).select(c("tk").alias("need")).distinct()
        texts = rows.join(small(need), c("tk") == c("need"), "left_semi").groupBy("tk").agg(F.first("text").alias("text"))
        return scratch.save(texts.select("text").mapInArrow(_blobs(k), "sign bigint, blob binary").dropDuplicates(["sign"]))

    def verified(pairs: DataFrame) -> DataFrame:
        maps = maps_of(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
        near = pairs.join(maps.select(c("sign").alias("su"), c("n").alias("nu"), c("bits").alias("bu")), c("u") == c("su")).join(maps.select(c("sign").alias("sv"), c("n").alias("nv"), c("bits").alias("bv")), c("v") == c("sv"))
        near = scratch.save(near.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_plausible(percent), "u bigint, v bigint"))
        blobs = blobs_of(near.select(F.explode(F.array("u", "v")).alias("key")).distinct())
        full = near.join(blobs.select(c("sign").alias("su"), c("blob").alias("bu")), c("u") == c("su")).join(blobs.select(c("sign").alias("sv"), c("blob").alias("bv")), c("v") == c("sv"))
        out = scratch.save(full.select("u", "v", "bu", "bv").mapInArrow(_compare(percent), "u bigint, v bigint"))
        scratch.drop(maps, near, blobs)
        return out

    def joined(comp: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components after the links among `pairs`, which are between components, are added."""
        return linked(comp, verified(pairs)) if pairs.limit(1).count() else comp

    def linked(comp: DataFrame, links: DataFrame) -> DataFrame:
        if not links.limit(1).count():
            return comp
        side = lambda x: comp.select(c("node").alias(f"n{x}"), c("component").alias(f"c{x}"))
        links = links.join(side("u"), c("u") == c("nu"), "left").join(side("v"), c("v") == c("nv"), "left")
        links = scratch.save(links.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")))
        wide = components(links.select(c("cu").alias("u"), c("cv").alias("v")), scratch).select(c("node").alias("wn"), c("component").alias("wide"))
        nodes = comp.unionByName(links.select(c("u").alias("node"), c("cu").alias("component"))).unionByName(links.select(c("v").alias("node"), c("cv").alias("component"))).distinct()
        return scratch.save(nodes.join(wide, c("component") == c("wn"), "left").select("node", F.coalesce("wide", "component").alias("component")))

    # One hub for each set first: that joins most groups. Then the other hubs of sets still apart.
    once = scratch.save(stars.groupBy("sign").agg(F.min("other").alias("v")).select(F.least("sign", "v").alias("u"), F.greatest("sign", "v").alias("v")).distinct())
    comp = scratch.save(components(verified(once), scratch))
    side = lambda x: comp.select(c("node").alias(f"n{x}"), c("component").alias(f"c{x}"))
    more = stars.select(F.least("sign", "other").alias("u"), F.greatest("sign", "other").alias("v")).distinct().join(once, ["u", "v"], "left_anti")
    more = more.join(side("u"), c("u") == c("nu"), "left").join(side("v"), c("v") == c("nv"), "left")
    more = scratch.save(more.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v"))
    comp = joined(comp, more)

    def lists(comp: DataFrame) -> DataFrame:
        """Lists that sets of more than one component share, with their sizes."""
        at = met.join(comp, c("sign") == c("node"), "left").select("token", "sign", "n", "pos", F.coalesce("component", "sign").alias("comp")).dropDuplicates(["token", "sign"])
        apart = at.groupBy(c("token").alias("t")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
        return at.join(apart.select("t", "size"), c("token") == c("t")).drop("t")

    # Short lists: all pairs of sets that are still apart.
    split = scratch.save(lists(comp).where(c("size") <= LIST).drop("size"))
    a, b = split.select(*[c(x).alias(f"a_{x}") for x in split.columns]), split.select(*[c(x).alias(f"b_{x}") for x in split.columns])
    rest = a.join(b, (c("a_token") == c("b_token")) & (c("a_sign") < c("b_sign")) & (c("a_comp") != c("b_comp")) & possible(c("a_n"), c("b_n"), c("a_pos"), c("b_pos")))
    rest = scratch.save(rest.select(c("a_sign").alias("u"), c("b_sign").alias("v")).distinct().join(once.unionByName(more), ["u", "v"], "left_anti"))
    comp = joined(comp, rest)
    # Long lists: blocks of sets against blocks, without listing pairs.
    long = lists(comp).where(c("size") > LIST).withColumn("blocks", F.ceil(c("size") / BLOCK).cast("int"))
    long = long.withColumn("own", F.pmod(F.xxhash64("sign"), c("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    long = scratch.save(long.select("token", "sign", "n", "comp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
    if long.limit(1).count():
        maps = maps_of(long.select(c("sign").alias("key")).distinct()).select(c("sign").alias("key"), "bits")
        hopeful = long.join(maps, c("sign") == c("key")).drop("key").groupBy("token", "a", "b").applyInArrow(_hopeful(percent), "token bigint, a int, b int, own int, sign bigint, comp bigint")
        hopeful = scratch.save(hopeful)
        blobs = blobs_of(hopeful.select(c("sign").alias("key")).distinct()).select(c("sign").alias("key"), "blob")
        found = hopeful.join(blobs, c("sign") == c("key")).drop("key").groupBy("token", "a", "b").applyInArrow(_joining(percent), "u bigint, v bigint")
        comp = linked(comp, scratch.save(found.distinct()))
    whole = own.join(comp, c("sign") == c("node"), "left").select("sign", F.coalesce("component", "sign").alias("comp"), "least")
    name = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
    name = whole.join(name, "comp").select(c("sign").alias("s"), "component_id")
    out = scratch.save(sets.join(name, c("sign") == c("s"), "left").select("doc_id", "tk", c("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.keep(out)
    return out


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id; of rows that
    repeat an id in one component, the one with the least text hash, once. Documents without words
    all stay, and so do rows without an id that no row with an id is linked with."""
    scratch = Scratch(docs.sparkSession)
    rows = classes(docs, doc_id=doc_id, text=text, scratch=scratch, **more)
    worded = rows.where("n_shingles > 0 and component_id is not null")
    first = worded.where("doc_id = component_id").groupBy("component_id").agg(F.min("tk").alias("best"))
    goes = worded.join(first.withColumnRenamed("component_id", "c"), F.col("component_id") == F.col("c"))
    goes = goes.where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tk") == F.col("best"))))
    goes = scratch.save(goes.select(F.col("doc_id").alias("__tm_id"), F.col("tk").alias("__tm_tk")).distinct())
    key = F.xxhash64(F.col(f"`{text}`"))
    kept = docs.join(small(goes), F.col(f"`{doc_id}`").eqNullSafe(F.col("__tm_id")) & (key == F.col("__tm_tk")), "left_anti")
    scratch.keep(rows, goes)
    again = scratch.save(worded.where("doc_id is not null").groupBy(F.col("doc_id").alias("__tm_id"), F.col("tk").alias("__tm_tk")).count().where("count > 1").drop("count"))
    scratch.keep(goes, again)
    if not again.limit(1).count():
        return kept
    same = (F.col(f"`{doc_id}`") == F.col("__tm_id")) & (key == F.col("__tm_tk"))
    once = kept.join(small(again), same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(small(again), same, "left_anti").unionByName(once)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[p : p + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(p) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS u, b.rid AS v, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, (SELECT min(o.doc_id) FROM r JOIN d o ON o.rid = r.v WHERE r.u = d.rid)) AS component_id
FROM d LEFT JOIN n USING (rid)
"""
