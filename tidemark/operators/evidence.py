"""Evidence, verification of claims, tracks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros, numbers_in


def evidence_top(events: DataFrame, *, top: int = 6) -> DataFrame:
    """events(entity, family, observed_at, weight, tie): the strongest few of each family, all
    entities in one pass."""
    w = Window.partitionBy("entity", "family").orderBy(F.desc("weight"), F.desc("observed_at"), "tie")
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def bundles(evidence: DataFrame, budget: int) -> DataFrame:
    """evidence(entity, family, rank, size) with ids E1, E2, ... while they fit the budget: ids go
    by rank and family, so weaker evidence is what is left out. A running sum, nothing sequential."""
    w = Window.partitionBy("entity").orderBy("rank", "family")
    out = evidence.withColumn("total", F.sum("size").over(w)).withColumn("n", F.row_number().over(w)).where(F.col("total") <= budget)
    return out.withColumn("evidence_id", F.concat(F.lit("E"), F.col("n").cast("string"))).drop("n")


def ungrounded_numbers(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, number) of numbers that a claim's text has and its sources' texts don't."""
    said = claims.select(key, F.explode(F.array_distinct(numbers_in("text"))).alias("number"))
    known = sources.select(key, F.explode(F.array_distinct(numbers_in("text"))).alias("number")).distinct()
    return said.join(known, [key, "number"], "left_anti").distinct()


def dangling(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations(entity, evidence_id) of evidence that isn't there."""
    return citations.join(evidence.select("entity", "evidence_id"), ["entity", "evidence_id"], "left_anti")


def first_fixes(positions: DataFrame, minutes: int = 10) -> DataFrame:
    """The first position of each transmitter in each span of time."""
    slot = F.window(F.col("observed_at"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    g = positions.withColumn("slot", slot).groupBy("mmsi", "slot")
    return g.agg(F.min_by(F.struct("observed_at", "lat", "lon", "event_id"), F.struct("observed_at", "event_id")).alias("p")).select("mmsi", "slot", "p.*")


def thin(track: DataFrame, *, spacing_s: float = 600.0, most: int = 4000, gap_s: float = 3600.0) -> DataFrame:
    """Greedy thinning of each mmsi's track: a fix is kept if it is `spacing_s` after the last one
    kept, if a gap follows, or if it is the last. Of more than `most`, `most` are kept at even
    positions, and besides them the last and all that come over `gap_s` after the one before.

    The choice depends on the one before, so it is made row by row over Arrow batches of partitions
    sorted by transmitter: one fix and two numbers are held, whatever the length of a track."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, 0
        for f in frames:
            keep = []
            for m, t, after in zip(f["mmsi"].tolist(), f["us"].tolist(), f["next"].tolist()):
                if m != key:
                    key, held = m, None
                ok = held is None or t - held >= spacing_s * 1e6 or after != after or after - t >= spacing_s * 1e6
                keep.append(ok)
                held = t if ok else held
            yield f[keep].drop(columns=["us", "next"])

    w = Window.partitionBy("mmsi").orderBy("observed_at", "event_id")
    rows = track.withColumn("us", micros("observed_at")).withColumn("next", F.lead("us").over(w).cast("double"))
    rows = rows.repartition("mmsi").sortWithinPartitions("mmsi", "observed_at", "event_id")
    kept = rows.mapInPandas(run, track.schema)
    n = F.count("*").over(Window.partitionBy("mmsi"))
    kept = kept.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", n).withColumn("_since", micros("observed_at") - F.lag(micros("observed_at")).over(w))
    step = F.col("_all") / F.lit(float(most))
    near = F.ceil(F.col("_n") / step)
    even = F.lit(False)
    for j in (near - 1, near, near + 1):  # the j-th of the even positions is floor(j * step)
        even = even | (j >= 0) & (j < most) & (F.floor(j * step) == F.col("_n"))
    stays = (F.col("_all") <= most) | even | (F.col("_n") == F.col("_all") - 1) | F.coalesce(F.col("_since") > gap_s * 1e6, F.lit(False))
    return kept.where(stays).drop("_n", "_all", "_since")


def position_at(track: DataFrame, instants: DataFrame) -> DataFrame:
    """instants(mmsi, at): the position between the fixes around each instant, in proportion to
    time; null outside the track. One window over both, no join."""
    both = track.select("mmsi", F.col("observed_at").alias("t"), F.struct(micros("observed_at").alias("us"), "lat", "lon").alias("p"), F.lit(False).alias("ask"))
    both = both.unionByName(instants.select("mmsi", F.col("at").alias("t"), F.lit(None).cast(both.schema["p"].dataType).alias("p"), F.lit(True).alias("ask")))
    w = Window.partitionBy("mmsi").orderBy("t", "ask")
    back = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"a": back, "b": ahead}).where("ask").withColumn("us", micros("t"))
    share = F.when(F.col("a.us") == F.col("us"), F.lit(0.0)).otherwise((F.col("us") - F.col("a.us")) / (F.col("b.us") - F.col("a.us")))
    there = F.col("a.us") == F.col("us")
    mid = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}")))
    return out.select("mmsi", F.col("t").alias("at"), F.round(mid("lat"), 6).alias("lat"), F.round(mid("lon"), 6).alias("lon"))
