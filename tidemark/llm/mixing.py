"""Mixing sources to target weights with DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of one source's hash-random keys, about, at most; ranges are cut and sorted alone.
RANGE_ROWS = 50_000
#: Ranges of a source at least.
RANGES = 1024


def words(text: str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes(source, source_size), one row per source, with `target`.

    Sources by code point, null last, have the weights in turn, repeating, and share the sum of all
    sizes by weight; a target stops at `cap` times its source's size and the excess is reshared by
    weight. The fixed point is min(cap * size, x * weight) for one x: by growing cap * size / weight,
    sources fill up one after the other, and x follows from what the full ones leave. Windows here
    run over one row per source, never over documents. An empty table gives no rows; where all
    sizes are 0 all targets are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("x", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    w = w.withColumn("x", F.when(F.col("x") * F.col("w") <= F.col("most"), F.col("x")))  # first source that isn't full
    w = w.withColumn("x", F.first("x", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", F.least("most", F.coalesce(F.col("x") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), cap: int = 3, seed: str = "mix", ranges: int | None = None, keep=()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (whole copies) and
    taken (words that the mix takes: `epochs` copies and the first words of one more).

    Each document has a key, a digest of seed, id and text, so documents of a source are in a random
    order that reruns repeat. Keys are even, so their leading bits cut each source, a hot one too,
    into `ranges` even ranges, by default as many as hold about RANGE_ROWS rows each even if all
    rows are of one source: words are summed per range before anything is shuffled wide, prefix
    sums over ranges give each range its offset, and each range is sorted by a task of its own. The
    budget, the whole part of the target, is cut inside the document that it falls in.

    Null texts have no words and nothing is taken; null sources are one source, the last. Rows that
    agree in id and text are ordered among themselves by size, which leaves no choice that shows.
    `keep` names further columns to return. An empty table gives no rows.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    if ranges is None:
        ranges = max(RANGES, min(1 << 28, docs.count() // RANGE_ROWS))
    bits = max(1, (ranges - 1).bit_length())
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__tm_k{i}") for i, c in enumerate(keep)],
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), key.alias("key"),
    ).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, cap=cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    null = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))
    plan = plan.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.select(null("source")[0].alias("p0"), null("source")[1].alias("p1"), F.col("bucket").alias("p2"), "offset", "source_size", "target")
    rows = rows.withColumns({"k0": null("source")[0], "k1": null("source")[1]})
    inside = Window.partitionBy("k0", "k1", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(plan, (F.col("k0") == F.col("p0")) & (F.col("k1") == F.col("p1")) & (F.col("bucket") == F.col("p2")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    out = out.withColumn("epochs", epochs)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"), *[F.col(f"__tm_k{i}") for i in range(len(keep))])


def op3_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS x
      FROM w WINDOW p AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT arg_min(x, (most / w, source)) AS x FROM f WHERE x * w <= most),
t AS (SELECT f.source, f.source_size, least(f.most, coalesce((SELECT x FROM x) * f.w, f.most)) AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS b,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (b // source_size) * size + greatest(0, least(size, b % source_size - before)) END AS BIGINT) AS taken
FROM c
"""
