"""The feature store: all features of all entities at all cutoffs, in one job.

Every table is joined with the broadcast cutoffs (one row for each date) and grouped by (cutoff,
entity); rows known after a cutoff never meet it. Families meet in left joins from the population.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import sessionize

#: Features that stay null where there is nothing to tell; the others are 0.
NULLABLE = {"days_since_last_identity_change", "current_flag", "mean_transit_speed_kn", "spoof_jump_rate_excess", "days_since_last_port_visit_of_interest", "vessel_age_years", "length_m", "dwt", "share_destination_of_interest", "max_gap_distance_km"}


def end_of(cutoff) -> F.Column:
    """23:59:59 of the day."""
    return (F.col(cutoff).cast("timestamp_ntz") + F.expr("interval 1 day") - F.expr("interval 1 second")).cast("timestamp_ntz")


def known(rows: DataFrame, at: DataFrame, lookback: int | None) -> DataFrame:
    """rows(mmsi, observed_at) with cutoff and entity: of the look-back window, or of all time.
    at(cutoff, mmsi, entity) has the entity of each transmitter at each cutoff. Rows that have
    cutoff and entity already, of all time, are only cut to the window."""
    out = rows
    if not {"cutoff", "entity"} <= set(rows.columns):
        a = at.select("cutoff", F.col("mmsi").alias("am"), "entity")
        out = rows.join(a, (F.col("mmsi") == F.col("am")) & (F.col("observed_at") <= end_of("cutoff"))).drop("am")
    return out if lookback is None else out.where(F.col("observed_at") >= F.date_sub("cutoff", lookback).cast("timestamp_ntz"))


_BY = ["cutoff", "entity"]


def population(positions: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    return known(positions, at, lookback).select(*_BY).distinct()


def ais(positions: DataFrame, at: DataFrame, lookback: int, gap_hours: float = 12.0) -> DataFrame:
    """positions(mmsi, observed_at, event_id, sog)."""
    rows = known(positions, at, lookback)
    runs = sessionize(rows, _BY, "observed_at", "event_id", gap_hours * 3600)
    # a sum of decimals doesn't depend on the order of rows
    speed = F.sum(F.when(F.col("sog") >= 3, F.col("sog").cast("decimal(18,6)"))).cast("double")
    return runs.groupBy(*_BY).agg(F.max("session").alias("n_transits"), F.count_distinct(F.to_date("observed_at")).alias("n_days_observed"), F.round(speed / F.count(F.when(F.col("sog") >= 3, 1)), 6).alias("mean_transit_speed_kn"))


def loads(positions: DataFrame, readings: DataFrame, at: DataFrame, lookback: int, gap_hours: float = 12.0) -> DataFrame:
    """Transits by their deepest reading, against the upper quartile of an entity's daily maxima.
    Days of a transit are listed, so transits meet readings(mmsi, observed_at, draught) by day."""
    runs = sessionize(known(positions, at, lookback), _BY, "observed_at", "event_id", gap_hours * 3600)
    runs = runs.groupBy(*_BY, "session").agg(F.to_date(F.min("observed_at")).alias("d0"), F.to_date(F.max("observed_at")).alias("d1"))
    daily = known(readings, at, lookback).where("draught > 0").groupBy(*_BY, F.to_date("observed_at").alias("day")).agg(F.max("draught").alias("deep"))
    high = daily.groupBy(*_BY).agg(F.percentile("deep", 0.75).alias("p75"))
    days = runs.withColumn("day", F.explode(F.sequence("d0", "d1"))).join(daily, [*_BY, "day"], "left")
    each = days.groupBy(*_BY, "session").agg(F.max("deep").alias("deep")).join(high, _BY, "left")
    return each.groupBy(*_BY).agg(F.count(F.when(F.col("deep") > F.col("p75"), 1)).alias("n_laden_transits"), F.count(F.when(F.col("deep") <= F.col("p75"), 1)).alias("n_ballast_transits"))


def destinations(statics: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    """statics(mmsi, observed_at, interest): the mean over days of the daily share."""
    daily = known(statics, at, lookback).groupBy(*_BY, F.to_date("observed_at").alias("day")).agg(F.avg(F.col("interest").cast("double")).alias("share"))
    return daily.groupBy(*_BY).agg(F.round(F.avg("share"), 6).alias("share_destination_of_interest"))


def spoof(excess: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    """excess(mmsi, observed_at, excess)."""
    return known(excess, at, lookback).groupBy(*_BY).agg(F.round((F.sum(F.col("excess").cast("decimal(18,6)")).cast("double") / F.count("excess")).cast("decimal(20,12)"), 6).cast("double").alias("spoof_jump_rate_excess"))


def third_party(events: DataFrame, at: DataFrame, lookback: int, offshore_km: float = 92.6) -> DataFrame:
    """events(mmsi, observed_at, event_id, type, hours, km, shore_km, listed, interest)."""
    rows, typ = known(events, at, lookback), F.col("type")
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c, v: F.round(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0)), 6)
    out = rows.groupBy(*_BY).agg(
        n(typ == "gap").alias("n_gaps"), total(typ == "gap", "hours").alias("gap_hours_total"), F.max(F.when(typ == "gap", F.col("km"))).alias("max_gap_distance_km"), n((typ == "gap") & (F.col("shore_km") > offshore_km)).alias("n_gaps_offshore"),
        n(typ == "encounter").alias("n_encounters"), F.count_distinct(F.when((typ == "encounter") & F.col("listed"), F.col("event_id"))).alias("n_encounters_with_listed_partner"),
        n(typ == "loitering").alias("n_loitering"), total(typ == "loitering", "hours").alias("loitering_hours"), n(typ == "port_visit").alias("n_port_visits"), n((typ == "port_visit") & F.col("interest")).alias("n_port_visits_of_interest"),
    )
    last = known(events, at, None).where((typ == "port_visit") & F.col("interest")).groupBy(*_BY).agg(F.max("observed_at").alias("last"))
    last = last.select(*_BY, F.datediff("cutoff", "last").cast("long").alias("days_since_last_port_visit_of_interest"))
    return out.join(last, _BY, "full")


def identity(intervals: DataFrame, at: DataFrame, convenience: list) -> DataFrame:
    """intervals(mmsi, start, name, flag), lifetime up to each cutoff."""
    rows = known(intervals.withColumn("observed_at", F.col("start")), at, None)
    w = Window.partitionBy(*_BY).orderBy("start", "mmsi")
    for c in ("mmsi", "flag", "name"):
        rows = rows.withColumn(f"_{c}", (F.col(c) != F.lag(c).over(w)))
    changed = F.col("_mmsi") | F.col("_flag") | F.col("_name")
    return rows.groupBy(*_BY).agg(
        F.greatest(F.count_distinct("name") - 1, F.lit(0)).alias("n_name_changes"), F.count(F.when(F.col("_mmsi"), 1)).alias("n_mmsi_changes"), F.count(F.when(F.col("_flag"), 1)).alias("n_flag_changes"),
        F.coalesce(F.bool_or(F.col("_flag") & F.col("flag").isin(*convenience)), F.lit(False)).cast("int").alias("flag_to_convenience_registry"),
        F.datediff(F.first("cutoff"), F.max(F.when(changed, F.col("start")))).cast("long").alias("days_since_last_identity_change"),
        F.max_by("flag", F.struct("start", "mmsi")).alias("current_flag"),
    )


def meetings(transfers: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    """transfers(a, b, observed_at): both sides, where they belong to different entities."""
    b = at.select("cutoff", F.col("mmsi").alias("bm"), F.col("entity").alias("other"))
    rows = known(transfers.withColumn("mmsi", F.col("a")), at, lookback).withColumnRenamed("cutoff", "t")
    rows = rows.join(b, (F.col("t") == F.col("cutoff")) & (F.col("b") == F.col("bm"))).where("entity <> other")
    return rows.withColumn("entity", F.explode(F.array("entity", "other"))).groupBy(*_BY).agg(F.count("*").alias("n_sts_candidates"))


def detections(loiter: DataFrame, draught: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    """loiter(mmsi, observed_at, hours); draught(mmsi, observed_at, moored_between, met_between)."""
    a = known(loiter, at, lookback).groupBy(*_BY).agg(F.round(F.sum(F.col("hours").cast("decimal(18,6)")).cast("double"), 6).alias("anchorage_loitering_hours"))
    d = known(draught, at, lookback).groupBy(*_BY)
    d = d.agg(F.count(F.when(F.col("met_between"), 1)).alias("n_sts_with_draught_change"), F.count(F.when(~F.col("moored_between") & ~F.col("met_between"), 1)).alias("n_draught_inconsistencies"))
    return a.join(d, _BY, "full")


def churned(changes: DataFrame, at: DataFrame) -> DataFrame:
    """changes(mmsi, observed_at): transmitters beyond the first, and number changes, lifetime."""
    own = at.groupBy(*_BY).agg((F.count_distinct("mmsi") - 1).alias("more"))
    n = known(changes, at, None).groupBy(*_BY).agg(F.count("*").alias("n"))
    return own.join(n, _BY, "left").select(*_BY, (F.col("more") + F.coalesce("n", F.lit(0))).alias("n_mmsi_number_churn"))


def static(vessel_days: DataFrame, at: DataFrame, lookback: int) -> DataFrame:
    """vessel_days(mmsi, observed_at, length)."""
    g = known(vessel_days, at, lookback).groupBy(*_BY).agg(F.mode("length", True).cast("double").alias("length_m"))
    return g.withColumns({"vessel_age_years": F.lit(None).cast("double"), "dwt": F.lit(None).cast("double")})


def assemble(people: DataFrame, families: list) -> DataFrame:
    """Population with all families; what a family doesn't tell is 0, or null where it may be."""
    out = people
    for f in families:
        out = out.join(f, _BY, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in out.dtypes if c not in _BY and c not in NULLABLE and t != "string"})
