"""Day tables from raw messages: typing, quality flags, profiles and the tables kept."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank_to_null, cell, contains_any, lenient, lenient_timestamp, number_valid, position_ok
from .temporal import change_points, dedup, downsample, is_jump, movement

NUMBERS = {"lat": "double", "lon": "double", "sog": "double", "cog": "double", "heading": "double", "rot": "double", "draught": "double", "length": "double", "width": "double"}
TEXTS = ["mobile_type", "nav_status", "callsign", "name", "ship_type", "cargo_type", "pos_fix_type", "destination", "eta", "data_source"]
STATIC = ["number", "callsign", "name", "ship_type", "cargo_type", "length", "width", "draught", "destination", "eta"]


def typed(raw: DataFrame) -> DataFrame:
    """Raw string columns as types; what can't be read is null. Columns that are missing are null."""
    have = set(raw.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    out = {"observed_at": lenient_timestamp(c("timestamp")).cast("timestamp_ntz"), "mmsi": lenient(F.trim(c("mmsi")), "bigint"), "number": lenient(F.trim(c("imo")), "bigint")}
    out |= {n: lenient(F.trim(c(n)), t) for n, t in NUMBERS.items()} | {n: blank_to_null(c(n)) for n in TEXTS}
    return raw.select(*[v.alias(k) for k, v in out.items()])


def flagged(rows: DataFrame, *, box=(-90.0, 90.0, -180.0, 180.0), other=("base station", "aton", "sar airborne")) -> DataFrame:
    """Exact duplicates but for their source once, with day, pos_ok and is_vessel."""
    key = [c for c in rows.columns if c != "data_source"]
    one = dedup(rows, key, [F.asc_nulls_last("data_source")])
    kind = F.lower(F.coalesce("mobile_type", F.lit("")))
    return one.withColumns({"day": F.to_date("observed_at"), "pos_ok": position_ok("lat", "lon", box), "is_vessel": ~kind.isin(*other)})


def _mode(c):
    """Most frequent value, the least of equals."""
    return F.mode(c, True)


def profile(rows: DataFrame, *, hazard=("dg", "haz")) -> DataFrame:
    """One row for each vessel and day: most frequent values, counts, and whether it carried."""
    tanker = F.lower(F.coalesce("ship_type", F.lit(""))).contains("tanker")
    cargo = F.lower(F.coalesce("ship_type", F.lit(""))).contains("cargo") & contains_any("cargo_type", hazard)
    g = rows.where("is_vessel and mmsi is not null and day is not null").groupBy("mmsi", "day")
    out = g.agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("pos_ok"), 1)).alias("n_pos_ok"), F.count(F.when(~F.col("pos_ok"), 1)).alias("n_bad_positions"),
        F.bool_or(tanker | cargo).alias("carrier_row"), *[_mode(c).alias(c) for c in ("mobile_type", "ship_type", "cargo_type", "length", "width", "name")],
        _mode(F.when(number_valid("number"), F.col("number"))).alias("number"),
    )
    return out.withColumn("carrier_today", F.col("carrier_row") & (F.coalesce("length", F.lit(100.0)) >= 100)).drop("carrier_row")


def kept(vessel_day: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """vessel_day with `kept`: a carrier that day, or on an earlier one, or on the list. The first
    day of each vessel stands for the registry, so days may come in any order."""
    first = F.min(F.when(F.col("carrier_today"), F.col("day"))).over(Window.partitionBy("mmsi"))
    out = vessel_day.withColumn("kept", F.col("carrier_today") | F.coalesce(first < F.col("day"), F.lit(False)))
    if allowed is not None:
        hit = allowed.select(F.col("mmsi").alias("am")).distinct().withColumn("hit", F.lit(True))
        out = out.join(hit, F.col("mmsi") == F.col("am"), "left").withColumn("kept", F.col("kept") | F.coalesce("hit", F.lit(False))).drop("am", "hit")
    return out


def jumps(rows: DataFrame, tie: str, *, size: float = 0.5, **limits) -> DataFrame:
    """Good positions with movement, cell and jumped, of each vessel and day."""
    good = rows.where("pos_ok and is_vessel and mmsi is not null and day is not null")
    return movement(good, ["mmsi", "day"], "observed_at", tie).withColumn("cell", cell("lat", "lon", size)).withColumn("jumped", is_jump(**limits))


def jump_baseline(moved: DataFrame) -> DataFrame:
    """(day, cell, n_vessels, n_jumped, share): how many of a cell's vessels jumped that day."""
    g = moved.groupBy("day", "cell").agg(F.count_distinct("mmsi").alias("n_vessels"), F.count_distinct(F.when(F.col("jumped"), F.col("mmsi"))).alias("n_jumped"))
    return g.withColumn("share", F.round(F.col("n_jumped") / F.col("n_vessels"), 6))


def artifacts(moved: DataFrame) -> DataFrame:
    """(mmsi, day, n_pos, n_jumps, cells): what each cell saw of a vessel's day, as structs."""
    each = moved.groupBy("mmsi", "day", "cell").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("jumped"), 1)).alias("n_jumps"))
    cells = F.array_sort(F.collect_list(F.struct("cell", "n_rows", "n_jumps")))
    return each.groupBy("mmsi", "day").agg(F.sum("n_rows").alias("n_pos"), F.sum("n_jumps").alias("n_jumps"), cells.alias("cells"))


def day_tables(raw: DataFrame, *, allowed: DataFrame | None = None, cells: float = 0.5) -> dict[str, DataFrame]:
    """All tables of all days in `raw`, lazily."""
    rows = flagged(typed(raw))
    days = kept(profile(rows), allowed)
    own = days.where("kept").select(F.col("mmsi").alias("km"), F.col("day").alias("kd"))
    mine = rows.join(own, (F.col("mmsi") == F.col("km")) & (F.col("day") == F.col("kd"))).drop("km", "kd")
    mine = mine.withColumn("tie", F.xxhash64(*[c for c in rows.columns if c not in ("day", "pos_ok", "is_vessel")]))
    moved = jumps(rows.withColumn("tie", F.xxhash64("lat", "lon", "sog", "cog")), "tie", size=cells)
    dynamic = downsample(mine.where("pos_ok"), "mmsi", "observed_at", "sog", "tie").select("observed_at", "mmsi", "lat", "lon", "sog", "cog", "heading", "rot", "nav_status", "mobile_type", "pos_fix_type", "data_source", "day")
    some = mine.where(F.coalesce(*[F.col(c).cast("string") for c in STATIC]).isNotNull())
    static = change_points(some, ["mmsi", "day"], ["observed_at", *[F.col(c) for c in STATIC]], STATIC).select("observed_at", "mmsi", "mobile_type", *STATIC, "day")
    return {"dynamic": dynamic, "static": static, "artifacts": artifacts(moved), "jump_baseline": jump_baseline(moved), "vessel_day": days, "fullres": mine.where("pos_ok").drop("tie")}


def missing_days(spark, start: str, end: str, done: DataFrame) -> DataFrame:
    """Days of [start, end] that done(day) lacks."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(done.select("day").distinct(), "day", "left_anti")


def frequencies(rows: DataFrame, c: str, top: int = 20) -> DataFrame:
    """Most frequent values of a column: a top-k report."""
    return rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)
