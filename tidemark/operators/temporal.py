"""Operators over time series of keyed rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import haversine_km, micros, seconds


def _window(key, *order):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def dedup(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key; null key values are equal."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def downsample(df: DataFrame, key: str, ts: str, speed: str, tie: str, *, limit: float = 3.0, slow: int = 30, fast: int = 60) -> DataFrame:
    """The first row of each key in buckets of `slow` seconds below `limit`, else of `fast`; a
    null speed counts as fast. Bucket lengths are kept apart."""
    size = F.when(F.col(speed) < limit, F.lit(slow)).otherwise(F.lit(fast))
    out = df.withColumn("_len", size).withColumn("_bucket", F.floor(seconds(ts) / F.col("_len")))
    return dedup(out, [key, "_len", "_bucket"], [ts, tie]).drop("_len", "_bucket")


def change_points(df: DataFrame, key: str, order: list, values: list) -> DataFrame:
    """Rows whose values differ from those of the row before, nulls being equal, and first rows."""
    w = _window(key, *order)
    now = F.struct(*values)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_was", F.lag(now).over(w))
    return out.where((F.col("_n") == 1) | ~now.eqNullSafe(F.col("_was"))).drop("_n", "_was")


def movement(df: DataFrame, key: str, ts: str, tie: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds dist_km, dt_s and implied_kn against the row before."""
    w = _window(key, ts, tie)
    out = df.withColumns({"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w), "_us": F.lag(micros(ts)).over(w)})
    out = out.withColumn("dist_km", haversine_km("_lat", "_lon", lat, lon)).withColumn("dt_s", (micros(ts) - F.col("_us")) / F.lit(1e6))
    knots = F.when(F.col("dt_s") > 0, F.col("dist_km") / F.lit(1.852) / (F.col("dt_s") / F.lit(3600.0)))
    return out.withColumn("implied_kn", knots).drop("_lat", "_lon", "_us")


def is_jump(min_km: float = 1.0, max_kn: float = 50.0) -> Column:
    """Of movement(): further than `min_km` in no time or faster than `max_kn`."""
    return F.coalesce((F.col("dist_km") > min_km) & ((F.col("dt_s") <= 0) | (F.col("implied_kn") > max_kn)), F.lit(False))


def gaps(df: DataFrame, key: str, ts: str, tie: str, hours: float) -> DataFrame:
    """(key, gap_start, gap_end, gap_hours) between rows further apart than `hours`."""
    w = _window(key, ts, tie)
    out = df.select(key, F.col(ts).alias("gap_start"), F.lead(ts).over(w).alias("gap_end"))
    out = out.withColumn("gap_hours", (micros("gap_end") - micros("gap_start")) / F.lit(3.6e9))
    return out.where(F.col("gap_hours") > hours)


def sessionize(df: DataFrame, key, ts: str, tie: str, tolerance_s: float) -> DataFrame:
    """Adds `session`, from 1 for each key; a row within the tolerance of the one before is in its
    session."""
    w = _window(key, ts, tie)
    new = F.when((micros(ts) - F.lag(micros(ts)).over(w)) <= F.lit(tolerance_s * 1e6), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fill_forward(df: DataFrame, key: str, order: list, values: list) -> DataFrame:
    w = _window(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def established(df: DataFrame, key: list, ts: str, nth: int) -> DataFrame:
    """(*key, since): the first instant of the nth distinct day on which a key is seen."""
    days = df.groupBy(*key, F.to_date(ts).alias("_day")).agg(F.min(ts).alias("since"))
    w = Window.partitionBy(*key).orderBy("_day")
    return days.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == nth).select(*key, "since")


def intervals(df: DataFrame, key: str, ts: str, values: list) -> DataFrame:
    """[start, end) of each run of equal values; the last one is open (null)."""
    runs = change_points(df, key, [ts], values).withColumnRenamed(ts, "start")
    return runs.select(key, *values, "start", F.lead("start").over(_window(key, "start")).alias("end"))


def flip_backs(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Adds `kind` of each change: first, flip_back (to the value before the last) or change."""
    w = _window(key, *order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    kind = F.when(one.isNull(), "first").when(F.col(value) == two, "flip_back").otherwise("change")
    return df.withColumn("kind", kind)


def asof_left(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, payload: list, tie: str | None = None) -> DataFrame:
    """Each left row with the payload of the last right row of its key at or before its time.

    One shuffle and one sort of both sides together, no join: right rows of an instant sort first,
    and the payload is a struct, so a null value in force isn't skipped."""
    own = F.struct(*left.columns)
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), own.alias("_row"), F.lit(None).cast(right.select(F.struct(*payload).alias("p")).schema["p"].dataType).alias("_p"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*payload).alias("_p"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_p", F.last("_p", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_p.{c}").alias(c) for c in payload])


def month_ends(spark, start: str, end: str) -> DataFrame:
    """Month ends within [start, end], as `cutoff`."""
    out = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    return out.select(F.last_day("m").alias("cutoff")).where(F.col("cutoff").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def monthly_cutoffs(spark, window_start: str, window_end: str, today: str, *, lookback: int = 180, horizon: int = 182) -> DataFrame:
    """Month ends with a whole look-back behind and a whole horizon before `today`; `supervised`
    tells those whose first cutoff is a horizon back, so that labels of it are known."""
    first = F.date_add(F.lit(window_start).cast("date"), lookback)
    last = F.least(F.lit(window_end).cast("date"), F.date_sub(F.lit(today).cast("date"), horizon))
    out = month_ends(spark, window_start, window_end).where(F.col("cutoff").between(first, last))
    low = F.min("cutoff").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("supervised", F.date_add(low, horizon) <= F.col("cutoff"))
