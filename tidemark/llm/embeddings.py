"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .jaccard import small
from .store import Scratch, received, ship

#: Vectors of one length that its rotations are learned from, at most.
SAMPLE = 20_000
#: Rows of one side of a block of comparisons, at most about; a larger bucket is cut into blocks.
BLOCK = 2048
#: Vectors of a length, not the commonest, up to which all of a label are one bucket, without codes.
FEW = 4 * BLOCK
#: Components of vectors of table rows that go through one call to Python, about.
TOGETHER = 50_000 * 64
#: Share of the pairs at the threshold, made from vectors that the rotations weren't learned from,
#: that the tables are made to find.
RECALL = 0.995
#: Rotations that are tried at most before keys are made shorter.
TURNS = 32
_SEED = 20_240_607


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Rotations learned by iterative quantisation for vectors of one length, and the substrings of
    their codes that are the keys of the Hamming tables."""

    def __init__(self, x: np.ndarray, threshold: float, width: int):
        """x: unit rows. Rotations of principal components alternate with the signs that they give
        until the codes of half of the sample are balanced; each gives one bit a dimension. Tables
        are added until pairs at the threshold, made from the other half, share a key in RECALL of
        all cases; where TURNS rotations don't reach that, rows aren't centred, and then keys become
        shorter by a bit, until they do. At one bit a key nearly
        every pair meets, so that it always ends. `radius` is the most bits in which codes of such
        pairs differ."""
        self.d = x.shape[1]
        rng = np.random.default_rng(_SEED)
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        near = threshold * x + math.sqrt(1 - threshold**2) * noise
        for w in range(max(1, min(width, self.d)), 0, -1):
            self.width = w
            if any(self._fit(x, near, mean) for mean in (x.mean(axis=0), np.zeros(self.d))):
                break
        a, b = self.bits(x), self.bits(near)
        self.radius = int((a != b).sum(axis=1).max(initial=0))

    def _fit(self, x: np.ndarray, near: np.ndarray, mean: np.ndarray) -> bool:
        rng = np.random.default_rng(_SEED + 1)
        self.mean, self.turns = mean, []
        v, axes = x - mean, np.eye(self.d)
        if len(x) > 1:
            axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
        v, near = v @ axes, (near - mean) @ axes
        missed, learn = np.ones(len(x), bool), v[::2]
        held = slice(1 if len(x) > 1 else 0, None, 2)
        while len(self.turns) < TURNS:
            r = np.linalg.qr(rng.standard_normal((self.d, self.d)))[0]
            for _ in range(30):
                u, _, t = np.linalg.svd(np.where(learn @ r >= 0, 1.0, -1.0).T @ learn)
                r = (u @ t).T
            self.turns.append(axes @ r)
            missed &= (self._keys(v @ r >= 0) != self._keys(near @ r >= 0)).all(axis=1)
            self.recall = 1 - float(missed[held].mean())
            if self.recall >= RECALL:
                return True
            if len(self.turns) >= 4 and missed.mean() ** (TURNS / len(self.turns)) > 1 - RECALL:
                return False  # at this pace the aim is out of reach
        return False

    def _keys(self, bits: np.ndarray) -> np.ndarray:
        """Keys of the tables of whole rotations."""
        w, n = self.width, self.d // self.width
        bits = bits.reshape(len(bits), -1, self.d)[:, :, : n * w].reshape(len(bits), -1, w)
        return (bits @ (1 << np.arange(w, dtype=np.int64))).astype(np.int64)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """The code of each row, one rotation after the other."""
        return np.concatenate([(x - self.mean) @ t >= 0 for t in self.turns], axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Key of each row in each table."""
        return self._keys(self.bits(x))


def _vectors(column: pa.Array):
    """Rows of a list column by length: (length, positions, matrix)."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    at = np.concatenate(([0], np.cumsum(ends)))
    for d in np.unique(ends).tolist():
        rows = np.flatnonzero(ends == d)
        yield d, rows, flat[at[rows][:, None] + np.arange(d)]


def _rows(a: np.ndarray):
    return [x.tobytes() for x in np.ascontiguousarray(a)]


def _code(tables):
    """Vectors as bytes, their codes, and their keys; one key for all of a length without tables."""

    def run(batches):
        learned = received(tables)
        for batch in batches:
            n = batch.num_rows
            keys, code, vec = [None] * n, [b""] * n, [b""] * n
            for d, rows, x in _vectors(batch.column(3)):
                own = learned.get(d)
                bits = own.bits(unit(x.astype(np.float64))) if own else None
                codes = _rows(np.packbits(bits, axis=1)) if own else [b""] * len(rows)
                found = own._keys(bits).tolist() if own else [[0]] * len(rows)
                for r, c, k, v in zip(rows.tolist(), codes, found, _rows(x)):
                    code[r], keys[r], vec[r] = c, k, v
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).value_lengths().cast(pa.int32()), pa.array(vec, pa.binary()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["c", "label", "m", "d", "vec", "code", "keys"])

    return run


def _matrix(column, kind) -> np.ndarray:
    """A binary column of equally long rows as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _words(codes: list) -> np.ndarray:
    """Equally long codes as rows of 64-bit words."""
    pad = b"\0" * (-len(codes[0]) % 8)
    return np.frombuffer(pad.join([*codes, b""]), np.uint64).reshape(len(codes), -1)


def _sides(table: pa.Table):
    """Positions of the two sides of a block."""
    own = table.column("own").to_numpy()
    return np.flatnonzero(own == table.column("a")[0].as_py()), np.flatnonzero(own == table.column("b")[0].as_py())


def _each(block, tables):
    """Applies block(table, learned) to each block of a bucket, of more than one row, among the
    rows of many: most buckets are small, and one call for each would cost more than its work."""
    held = []

    def run(table: pa.Table) -> pa.Table:
        if not held:
            held.append(received(tables))
        at = [table.column(x).to_numpy() for x in ("b", "a", "k", "t", "d")]
        at.append(pc.dictionary_encode(table.column("label").combine_chunks()).indices.to_numpy())
        order = np.lexsort(at)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in at:
            new[1:] |= x[order][1:] != x[order][:-1]
        edge = np.append(np.flatnonzero(new), len(order))
        parts = [block(table.slice(0, 0), None)]
        for i in np.flatnonzero(np.diff(edge) > 1).tolist():
            own = table.take(pa.array(order[edge[i] : edge[i + 1]]))
            parts.append(block(own, held[0].get(own.column("d")[0].as_py())))
        return pa.concat_tables(parts)

    return run


def _hopeful():
    """The members of a block that have another, not themselves, within the radius of their codes."""

    def run(table: pa.Table, learned) -> pa.Table:
        if not table.num_rows:
            return table.drop_columns(["code"])
        left, right = _sides(table)
        keep = np.zeros(table.num_rows, bool)
        if len(left) and len(right):
            words = _words(table.column("code").to_pylist())
            radius = learned.radius if learned else 0
            for i in range(0, len(left), 256):
                rows = left[i : i + 256]
                differ = np.zeros((len(rows), len(right)), np.int32)
                for k in range(words.shape[1]):
                    differ += np.bitwise_count(words[rows, k][:, None] ^ words[right, k][None, :])
                near = (differ <= radius) & (rows[:, None] != right[None, :])
                keep[rows] |= near.any(axis=1)
                keep[right] |= near.any(axis=0)
        return table.drop_columns(["code"]).filter(pa.array(keep))

    return run


def _link(threshold: float, kind: str):
    """Links of one block of a bucket that no earlier table has: for each row the weight of its
    partners, and the least row of the component that the block makes of them."""

    def run(table: pa.Table, learned) -> pa.Table:
        if not table.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in ("c", "links", "root")})
        table = table.take(pa.array(np.argsort(table.column("c").to_numpy(), kind="stable")))
        ids, m = table.column("c").to_numpy(), table.column("m").to_numpy()
        left, right = _sides(table)
        x = unit(_matrix(table.column("vec"), kind).astype(np.float64))
        t = table.column("t")[0].as_py()
        keys = learned._keys(np.unpackbits(_matrix(table.column("code"), np.uint8), axis=1)[:, : len(learned.turns) * learned.d].astype(bool))[:, :t] if learned else np.zeros((len(ids), 0), np.int64)
        total, comp = np.zeros(len(ids), np.int64), np.arange(len(ids))
        near = x[left] @ x[right].T >= threshold
        if len(left) == len(right) and (left == right).all():
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 18):
            p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            new = ~(keys[left[p]] == keys[right[q]]).any(axis=1)
            near[p[~new], q[~new]] = False
        total[left] += near @ m[right]
        if table.column("a")[0].as_py() != table.column("b")[0].as_py():
            total[right] += near.T @ m[left]
        while len(i):  # the least row that links reach, by rounds of minima
            low = np.minimum(comp[left[i]], comp[right[j]])
            new = comp.copy()
            np.minimum.at(new, left[i], low)
            np.minimum.at(new, right[j], low)
            new = new[new]
            if (new == comp).all():
                break
            comp = new
        keep = np.flatnonzero((total > 0) | (comp != np.arange(len(ids))))
        return pa.table({"c": ids[keep], "links": total[keep], "root": ids[comp[keep]]})

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, sample: int = SAMPLE, block: int = BLOCK, few: int = FEW, width: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector.

    Vectors of one label link when their cosine, in double precision, is `threshold` or more. The
    rotations are learned, for each length on its own, from at most `sample` of its vectors; all
    vectors are then in all tables. Only codes go to the tables: members of a bucket that have
    another within the radius of their codes are found there, and these alone fetch their vectors,
    on which pairs are compared, in the first table that has both, so each link is counted once and
    no pairs are listed. Of lengths beside the commonest, those that have at most `few` vectors need
    no codes: all of a label are one bucket. Equal vectors
    of a label are one row with a weight. Buckets over `block` rows are cut into blocks and each
    pair of blocks is compared by a task of its own. Keys are longer (`width` bits) the more
    vectors there are, so that buckets don't grow with the table, unless too many pairs were missed.

    Null vectors, empty ones, those of zeros and those with null or non-finite components link with
    nothing, nor do rows without a label; vectors of different lengths don't link. Null ids count
    as a component's id only where nothing in it has one, and are never kept. Repeated rows are
    copies. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col(embedding)
    if vectors.schema[embedding].dataType.simpleString() not in ("array<float>", "array<double>"):
        e = e.cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    sound = F.coalesce(sound & F.col(label).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound, F.col(label)).alias("label"), F.when(sound, e).alias("e"))
    rows = rows.withColumn("h", F.when(F.col("e").isNotNull(), F.struct(F.xxhash64("label", "e").alias("a"), F.xxhash64("e", "label", F.lit(_SEED)).alias("b"))))
    own = rows.where("h is not null").groupBy("h").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    own = scratch.save(own.withColumn("c", F.monotonically_increasing_id()))
    sizes = own.groupBy(F.size("e").alias("d")).count()
    sizes = sizes.where(F.col("count") > few).orderBy("d").collect() or sizes.orderBy(F.desc("count"), "d").limit(1).collect()  # a row per `few` vectors at most
    learned = {}
    for d, n in sizes:
        fit = own.where(F.size("e") == d).orderBy(F.xxhash64("h"), "c").limit(sample).select("e").toArrow()
        fit = unit(np.concatenate([x for _, _, x in _vectors(fit.column(0).combine_chunks())]).astype(np.float64))
        learned[d] = Tables(fit, threshold, width or max(8, math.ceil(math.log2(n / 4000 + 1))))
    tables = ship(spark, learned)
    kind = own.schema["label"].dataType.simpleString()
    coded = scratch.save(own.select("c", "label", "m", "e").mapInArrow(_code(tables), f"c bigint, label {kind}, m bigint, d int, vec binary, code binary, keys array<bigint>"))

    bucket = ["label", "d", "t", "k"]
    slim = coded.select("c", "label", "d", "code", F.posexplode("keys").alias("t", "k"))
    large = slim.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = scratch.save(large.select(*[F.col(x).alias(f"l_{x}") for x in bucket], F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    met = slim.join(small(large), [F.col(x) == F.col(f"l_{x}") for x in bucket], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [*bucket, "a", "b"]
    met = met.select("c", "code", "own", *bucket, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    most = max((len(t.turns) * (t.d // t.width) * t.d for t in learned.values()), default=1)
    met = met.withColumn("g", F.pmod(F.xxhash64(*place), F.lit(max(12, own.count() * most // TOGETHER))).cast("int"))
    hopeful = met.groupBy("g").applyInArrow(_each(_hopeful(), tables), f"c bigint, own int, label {kind}, d int, t int, k bigint, a int, b int, g int")
    hopeful = scratch.save(hopeful)
    full = hopeful.join(coded.select(F.col("c").alias("vc"), "m", "vec", "code"), F.col("c") == F.col("vc")).drop("vc")
    single = "float" if own.schema["e"].dataType.elementType.simpleString() == "float" else "double"
    found = scratch.save(full.groupBy("g").applyInArrow(_each(_link(threshold, {"float": "<f4", "double": "<f8"}[single]), tables), "c bigint, links bigint, root bigint"))
    scratch.drop(hopeful, coded, large)
    links = found.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "lc")
    comp = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")), scratch)
    whole = own.select("c", "h", "m", "least").join(links, F.col("c") == F.col("lc"), "left").join(comp, F.col("c") == F.col("node"), "left")
    whole = scratch.save(whole.select("h", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "c").alias("comp")))
    scratch.keep(whole)
    names = whole.groupBy("comp").agg(F.min("least").alias("name"))
    whole = whole.join(names, "comp").select(F.col("h").alias("wh"), "n", "name")
    out = rows.join(whole, F.col("h") == F.col("wh"), "left")
    component = F.coalesce("name", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS rid, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
l AS MATERIALIZED (
  SELECT a.rid AS u, b.rid AS v FROM d a JOIN d b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND CASE WHEN a.ok AND b.ok THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT d.rid, least(d.vec_id, min(o.vec_id)) AS m FROM d JOIN r ON r.u = d.rid JOIN d o ON o.rid = r.v GROUP BY d.rid, d.vec_id)
SELECT vec_id, coalesce(k, 0) AS n_links, CAST(coalesce(m, vec_id) AS BIGINT) AS component_id, coalesce(vec_id = coalesce(m, vec_id), false) AS kept
FROM d LEFT JOIN (SELECT u AS rid, count(*) AS k FROM l GROUP BY u) USING (rid) LEFT JOIN c USING (rid)
"""
