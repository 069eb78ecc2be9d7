"""Detectors of behaviour."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hours_between, micros
from .meetings import pair_runs
from .temporal import established, sessionize


def _minutes(df: DataFrame) -> DataFrame:
    return df.withColumn("minute", F.date_trunc("minute", F.col("observed_at")).cast("timestamp_ntz"))


def transfers(positions: DataFrame, *, metres: float = 500.0, max_kn: float = 2.0, tolerance_min: int = 10, min_hours: float = 2.0, min_cover: float = 0.5) -> DataFrame:
    """Runs of slow, unmoored pairs nearer than `metres`: minutes may miss up to the tolerance, a
    run lasts `min_hours` and has pairs in `min_cover` of its minutes."""
    slow = positions.where((F.col("sog") < max_kn) & ~F.contains(F.lower(F.coalesce("nav_status", F.lit(""))), F.lit("moor")))
    each = _minutes(slow).groupBy("mmsi", "minute").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    runs = pair_runs(each, "mmsi", "minute", metres, tolerance_min * 60.0, distance=True).withColumnRenamed("n", "minutes")
    runs = runs.withColumn("hours", hours_between("start", "end"))
    # in whole minutes: hours * 60 may be a little more than they are
    cover = F.col("minutes") >= F.lit(min_cover) * ((micros("end") - micros("start")) / F.lit(6e7) + 1)
    return runs.where((F.col("hours") >= min_hours) & cover).select("a", "b", "start", "end", "minutes", F.round("hours", 6).alias("hours"), "min_distance_m")


def loitering(positions: DataFrame, *, max_kn: float = 1.0, min_hours: float = 12.0, tolerance_min: int = 30) -> DataFrame:
    slow = _minutes(positions.where(F.col("sog") < max_kn)).groupBy("mmsi", "minute").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    runs = sessionize(slow, "mmsi", "minute", "minute", tolerance_min * 60.0).groupBy("mmsi", "session")
    runs = runs.agg(F.min("minute").alias("start"), F.max("minute").alias("end"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")).withColumn("hours", F.round(hours_between("start", "end"), 6))
    return runs.where(F.col("hours") >= min_hours).select("mmsi", "start", "end", "hours", "lat", "lon")


def value_changes(readings: DataFrame, moored: DataFrame, meetings: DataFrame, *, least: float = 1.0) -> DataFrame:
    """readings(mmsi, observed_at, value): changes of at least `least`, and what explains them.

    Instants with different readings are dropped. moored(mmsi, observed_at): a row strictly between
    the readings; meetings(a, b, start, end): an overlap, for either of the two. Meetings are one
    row for each side before the join, so both flags are existence tests on equi-joins."""
    one = readings.groupBy("mmsi", "observed_at").agg(F.min("value").alias("value"), F.max("value").alias("_hi")).where("value = _hi")
    w = Window.partitionBy("mmsi").orderBy("observed_at")
    ch = one.select("mmsi", F.lag("observed_at").over(w).alias("from_ts"), F.col("observed_at").alias("to_ts"), F.lag("value").over(w).alias("previous"), "value")
    ch = ch.withColumn("delta", F.col("value") - F.col("previous")).where(F.abs("delta") >= least)
    key = ["mmsi", "to_ts"]
    at = ch.join(moored.select(F.col("mmsi").alias("m"), F.col("observed_at").alias("t")), (F.col("mmsi") == F.col("m")) & (F.col("t") > F.col("from_ts")) & (F.col("t") < F.col("to_ts")), "left_semi").select(*key).withColumn("_moored", F.lit(True))
    sides = meetings.select(F.explode(F.array("a", "b")).alias("m"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = ch.join(sides, (F.col("mmsi") == F.col("m")) & (F.col("e") > F.col("from_ts")) & (F.col("s") < F.col("to_ts")), "left_semi").select(*key).withColumn("_met", F.lit(True))
    out = ch.join(at, key, "left").join(met, key, "left")
    return out.select("mmsi", "from_ts", "to_ts", "previous", "value", F.round("delta", 6).alias("delta"), F.coalesce("_moored", F.lit(False)).alias("moored_between"), F.coalesce("_met", F.lit(False)).alias("met_between"))


def excess_incidence(days: DataFrame, baseline: DataFrame) -> DataFrame:
    """days(mmsi, day, cells: array<struct<cell, n_rows, n_jumps>>): own incidence less what the
    cells that day show of all, weighted by own rows. baseline(cell, day, share)."""
    each = days.select("mmsi", "day", F.explode("cells").alias("c")).select("mmsi", "day", "c.cell", "c.n_rows", "c.n_jumps")
    b = baseline.select(F.col("cell").alias("bc"), F.col("day").alias("bd"), "share")
    each = each.join(b, (F.col("cell") == F.col("bc")) & (F.col("day") == F.col("bd")), "left")
    # in decimals, whose sums and ties don't depend on the order of rows
    part = F.sum(F.col("n_rows") * F.coalesce(F.col("share").cast("decimal(20,12)"), F.lit(0).cast("decimal(20,12)"))).cast("double") / F.sum("n_rows")
    out = each.groupBy("mmsi", "day").agg(F.sum("n_jumps").alias("n_jumps"), F.round(part.cast("decimal(20,12)"), 6).alias("expected"), F.count("*").alias("n_cells"))
    own = F.when(F.col("n_jumps") > 0, F.lit(1)).otherwise(F.lit(0))
    return out.select("mmsi", "day", "n_jumps", F.col("expected").cast("double").alias("expected"), (own - F.col("expected")).cast("double").alias("excess"), "n_cells")


def churn(reports: DataFrame, value: str, *, min_days: int = 5) -> DataFrame:
    """Changes between values that have been seen on `min_days` days, dated by that day."""
    sure = established(reports.where(F.col(value).isNotNull()), ["mmsi", value], "observed_at", min_days)
    w = Window.partitionBy("mmsi").orderBy("since", value)
    return sure.select("mmsi", F.col("since").alias("observed_at"), F.lag(value).over(w).alias("old_value"), F.col(value).alias("new_value")).where("old_value is not null")


def by_cell(events: DataFrame, hours: str, *, size: float = 0.05, top: int = 20) -> DataFrame:
    """The cells with most hours: a top-k report."""
    g = events.groupBy(F.floor(F.col("lat") / F.lit(size)).alias("x"), F.floor(F.col("lon") / F.lit(size)).alias("y"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(hours), 6).alias("hours")).orderBy(F.desc("hours"), "x", "y").limit(top)
