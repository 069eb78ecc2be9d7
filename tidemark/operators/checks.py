"""Cross-checks, profiles and samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_left


def coverage(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(month, n, n_vote, share): how many records had an entity by vote in force at their day."""
    right = entities.select("mmsi", "effective_from", "method")
    seen = asof_left(records, right, "mmsi", "day", "effective_from", ["method"], "method")
    g = seen.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count(F.when(F.col("method") == "vote", 1)).alias("n_vote"))
    return g.withColumn("share", F.round(F.col("n_vote") / F.col("n"), 6))


def fragmentation(reports: DataFrame, at: DataFrame) -> DataFrame:
    """(cutoff, number, n_entities, n_mmsi) of numbers whose carriers have more than one entity."""
    carriers = reports.where("number is not null").select("number", "mmsi").distinct()
    met = at.join(carriers.withColumnRenamed("mmsi", "m"), F.col("mmsi") == F.col("m"))
    return met.groupBy("cutoff", "number").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("mmsi").alias("n_mmsi")).where("n_entities > 1")


def date_agreement(a: DataFrame, b: DataFrame, days: int = 7) -> DataFrame:
    """a, b (id, date): of ids in both, how many dates are at most `days` apart."""
    met = a.groupBy("id").agg(F.min("date").alias("da")).join(b.groupBy("id").agg(F.min("date").alias("db")), "id")
    apart = F.abs(F.datediff("da", "db"))
    return met.agg(F.count("*").alias("n_both"), F.count(F.when(apart <= days, 1)).alias("n_agree"), F.max(apart).cast("long").alias("most_days"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def hash_order(*keys, seed: str = "sample") -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows, the same in every run: the first by a digest of the key. A sampling operator."""
    return df.withColumn("_h", hash_order(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows of each stratum, the same in every run."""
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return df.withColumn("_h", hash_order(key, seed=seed)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_h", "_n")


def attribute_changes(rows: DataFrame, key: str, order: list, values: list) -> DataFrame:
    """Rows at which a value differs from the one before, both being known, with the old values."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values})
    hit = F.lit(False)
    for v in values:
        hit = hit | F.coalesce(F.col(v) != F.col(f"previous_{v}"), F.lit(False))
    return out.where(hit)


def rates(verdicts: DataFrame, by: list, good: str) -> DataFrame:
    """Share of good verdicts by group."""
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col(good), 1.0).otherwise(0.0)), 4).alias("rate"))


def gap_verdict(gaps_at_edge: DataFrame, least: float = 0.5) -> DataFrame:
    """gaps_at_edge(near_edge): whether at least that share of gaps began near the edge."""
    g = gaps_at_edge.agg(F.count("*").alias("n"), F.count(F.when(F.col("near_edge"), 1)).alias("n_edge"))
    return g.withColumn("at_edge", F.col("n_edge") >= F.lit(least) * F.col("n"))
