"""Transmitters to entities by dated votes, and intervals of identity."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank_to_null, synthetic_id
from .temporal import change_points, established, fill_forward


def entity_map(reports: DataFrame, origin: str, *, window_days: int = 30, min_share: float = 0.6, min_days: int = 5) -> DataFrame:
    """reports(mmsi, day, number, length, width): the entity of each transmitter after each window.

    A day on which a transmitter names a number is a vote. Votes add up from window to window; the
    number with most (the least of equals) names the entity if it has `min_share` of all and
    `min_days`, else the transmitter has an id of its own. In force from the day after the window.
    """
    index = F.floor(F.datediff("day", F.lit(origin).cast("date")) / F.lit(window_days)).cast("long")
    seen = reports.withColumn("wi", index)
    votes = seen.where("number is not null").groupBy("mmsi", "wi", "number").agg(F.count_distinct("day").alias("votes"))
    grid = seen.select("mmsi", "wi").distinct().join(votes.select(F.col("mmsi").alias("m"), "number").distinct(), F.col("mmsi") == F.col("m"), "left").drop("m")
    v = votes.select(F.col("mmsi").alias("vm"), F.col("wi").alias("vw"), F.col("number").alias("vn"), "votes")
    grid = grid.join(v, (F.col("mmsi") == F.col("vm")) & (F.col("wi") == F.col("vw")) & (F.col("number") == F.col("vn")), "left").drop("vm", "vw", "vn")
    grid = grid.withColumn("cum", F.sum(F.coalesce("votes", F.lit(0))).over(Window.partitionBy("mmsi", "number").orderBy("wi")))
    every = Window.partitionBy("mmsi", "wi")
    best = grid.withColumn("all", F.sum("cum").over(every)).withColumn("n", F.row_number().over(every.orderBy(F.desc("cum"), F.asc_nulls_last("number")))).where("n = 1")
    shape = reports.groupBy("mmsi").agg(F.max("length").alias("length"), F.max("width").alias("width"))
    best = best.join(shape.withColumnRenamed("mmsi", "sm"), F.col("mmsi") == F.col("sm"))
    share = F.when(F.col("all") > 0, F.col("cum") / F.col("all")).otherwise(F.lit(0.0))
    sure = (share >= min_share) & (F.col("cum") >= min_days)
    return best.select(
        "mmsi", "wi", F.date_add(F.lit(origin).cast("date"), ((F.col("wi") + 1) * window_days).cast("int")).alias("effective_from"),
        F.when(sure, F.col("number").cast("string")).otherwise(synthetic_id("mmsi", "length", "width")).alias("entity"),
        F.when(sure, "vote").otherwise("synthetic").alias("method"), F.round(share, 6).alias("support"), F.col("cum").alias("n_votes"),
    )


def entity_at(entities: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, mmsi, entity) in force at each cutoff, for all cutoffs in one pass."""
    at = entities.join(F.broadcast(cutoffs.select("cutoff").distinct()), F.col("effective_from") <= F.col("cutoff"))
    return at.groupBy("cutoff", "mmsi").agg(F.max_by("entity", F.struct("effective_from", "entity")).alias("entity"))


def attributed(rows: DataFrame, entities: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows known by each cutoff, with the entity that their transmitter has then."""
    at = entity_at(entities, cutoffs)
    known = rows.join(F.broadcast(cutoffs.select("cutoff")), F.to_date("observed_at") <= F.col("cutoff"))
    return known.join(at.select(F.col("cutoff").alias("c"), F.col("mmsi").alias("m"), "entity"), (F.col("cutoff") == F.col("c")) & (F.col("mmsi") == F.col("m")), "left").drop("c", "m")


def identity_intervals(reports: DataFrame, values: list, *, placeholders=("", "0", "NONE", "UNKNOWN"), nth: int = 2) -> DataFrame:
    """reports(mmsi, observed_at, values...) as [start, end) intervals of established values.

    Values are trimmed and in upper case; placeholders are null, and so is a value that one instant
    reports differently. A value counts from its nth distinct day on; values fill forward."""
    clean = reports.select("mmsi", "observed_at", *[blank_to_null(F.upper(F.col(v))).alias(v) for v in values])
    clean = clean.select("mmsi", "observed_at", *[F.when(~F.col(v).isin(*placeholders), F.col(v)).alias(v) for v in values])
    one = clean.groupBy("mmsi", "observed_at").agg(*[F.when(F.count_distinct(v) == 1, F.max(v)).alias(v) for v in values])
    long = one.unpivot(["mmsi", "observed_at"], values, "field", "value").where("value is not null")
    sure = established(long, ["mmsi", "field", "value"], "observed_at", nth)
    known = long.join(sure.select(F.col("mmsi").alias("m"), F.col("field").alias("f"), F.col("value").alias("v"), "since"), (F.col("mmsi") == F.col("m")) & (F.col("field") == F.col("f")) & (F.col("value") == F.col("v")) & (F.col("observed_at") >= F.col("since")))
    wide = known.groupBy("mmsi", "observed_at").agg(*[F.max(F.when(F.col("field") == v, F.col("value"))).alias(v) for v in values])
    runs = change_points(fill_forward(wide, "mmsi", ["observed_at"], values), "mmsi", ["observed_at"], values)
    w = Window.partitionBy("mmsi").orderBy("observed_at")
    return runs.select("mmsi", *values, F.col("observed_at").alias("start"), F.lead("observed_at").over(w).alias("end"))


def threshold_sweep(entities: DataFrame, grid: DataFrame) -> DataFrame:
    """How many transmitter windows each (min_share, min_days) of a small grid would name."""
    met = entities.join(F.broadcast(grid), F.lit(True))
    return met.groupBy("min_share", "min_days").agg(F.count("*").alias("n"), F.count(F.when((F.col("support") >= F.col("min_share")) & (F.col("n_votes") >= F.col("min_days")), 1)).alias("n_named"))
