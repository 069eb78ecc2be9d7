"""Dated actions replayed into labels. actions(id, date, action, source)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEQ = ("date", "source", "action")


def listed_as_of(actions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, id, since) of ids on a list at each cutoff: an add lists, any remove clears, and
    `since` is the first add after the last remove. All cutoffs in one pass; ids are grouped with
    two partly pre-aggregated extremes, nothing is replayed row by row."""
    a = actions.join(F.broadcast(cutoffs.select("cutoff")), F.col("date") <= F.col("cutoff")).withColumn("seq", F.struct(*_SEQ))
    gone = a.where("action = 'remove'").groupBy("cutoff", "id").agg(F.max("seq").alias("gone"))
    adds = a.where("action = 'add'").join(gone, ["cutoff", "id"], "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return adds.groupBy("cutoff", "id").agg(F.min("date").alias("since"))


def first_add_in_window(actions: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """(cutoff, id, date, source) of the first add in (cutoff, cutoff + horizon]."""
    adds = actions.where("action = 'add'").join(F.broadcast(cutoffs.select("cutoff")), (F.col("date") > F.col("cutoff")) & (F.col("date") <= F.date_add("cutoff", horizon)))
    w = Window.partitionBy("cutoff", "id").orderBy("date", "source")
    return adds.withColumn("n", F.row_number().over(w)).where("n = 1").select("cutoff", "id", "date", "source")


def labels(population: DataFrame, actions: DataFrame, cutoffs: DataFrame, horizon: int, sources: list | None = None) -> DataFrame:
    """population(cutoff, id) without ids listed by then, with `label`: added within the horizon by
    one of `sources`."""
    left = population.join(listed_as_of(actions, cutoffs).select("cutoff", "id"), ["cutoff", "id"], "left_anti")
    pick = actions.where(F.col("source").isin(*sources)) if sources else actions
    hit = first_add_in_window(pick, cutoffs, horizon).select("cutoff", "id", F.lit(1).alias("hit"))
    return left.join(hit, ["cutoff", "id"], "left").select("cutoff", "id", F.coalesce("hit", F.lit(0)).alias("label"))


def positives(population: DataFrame, actions: DataFrame, cutoffs: DataFrame, horizon: int, sources: list) -> DataFrame:
    every = labels(population, actions, cutoffs, horizon).groupBy("cutoff").agg(F.count("*").alias("n"), F.sum("label").alias("n_union"))
    one = labels(population, actions, cutoffs, horizon, sources).groupBy("cutoff").agg(F.sum("label").alias("n_sources"))
    listed = population.join(listed_as_of(actions, cutoffs).select("cutoff", "id"), ["cutoff", "id"], "left_semi").groupBy("cutoff").agg(F.count("*").alias("n_listed"))
    out = every.join(one, "cutoff").join(listed, "cutoff", "left")
    return out.select("cutoff", "n", "n_union", "n_sources", F.coalesce("n_listed", F.lit(0)).alias("n_listed"))


def lead_times(scores: DataFrame, actions: DataFrame, k: int, horizon: int) -> DataFrame:
    """(id, date, cutoff, weeks): for each first add, the earliest cutoff at most `horizon` days
    before it whose top k of scores(cutoff, id, score) has the id."""
    w = Window.partitionBy("cutoff").orderBy(F.desc("score"), "id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cutoff", "id")
    first = actions.where("action = 'add'").groupBy("id").agg(F.min("date").alias("date"))
    met = first.join(top, "id").where((F.col("cutoff") < F.col("date")) & (F.col("date") <= F.date_add("cutoff", horizon)))
    return met.groupBy("id", "date").agg(F.min("cutoff").alias("cutoff")).withColumn("weeks", F.round(F.datediff("date", "cutoff") / F.lit(7.0), 6))
