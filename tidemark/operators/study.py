"""Evaluation beyond single metrics: summaries, matched cutoffs, leakage checks, ablation, dated lists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .score import _ranked, at_k, average_precision, macro_average, psi


def summary(s: DataFrame, ks=(10, 25, 50), by=("cutoff",)) -> DataFrame:
    """n, n_pos, base_rate, average precision, alerts for half of the positives, and precision and
    recall at each k, one row a cutoff; null where there are no positives."""
    by, first = list(by), at_k(s, ks[0], by)
    out = first.select(*by, "n", "n_pos", F.round(F.col("n_pos") / F.col("n"), 6).alias("base_rate"), "alerts_half", F.col("precision").alias(f"precision_{ks[0]}"), F.col("recall").alias(f"recall_{ks[0]}"))
    for k in ks[1:]:
        out = out.join(at_k(s, k, by).select(*by, F.col("precision").alias(f"precision_{k}"), F.col("recall").alias(f"recall_{k}")), by)
    return out.join(average_precision(s, by), by)


def matched(metrics: DataFrame, skipped: DataFrame, by=("cutoff", "label_set")) -> DataFrame:
    """Metrics of the cutoffs that every model was scored at; skipped(cutoff, label_set) are the others."""
    return metrics.join(skipped.select(*by).distinct(), list(by), "left_anti")


def by_regime(metrics: DataFrame, day: str, by: list, values: list) -> DataFrame:
    """Macro averages before a break and from it on."""
    side = F.when(F.col("cutoff") >= F.lit(day).cast("date"), "post_break").otherwise("pre_break")
    return macro_average(metrics.withColumn("side", side), ["side", *by], values)


def family_psi(df: DataFrame, side: str, families: dict) -> DataFrame:
    """(family, psi): the mean over a family's features {feature: family} of those that have one."""
    names = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    each = psi(df, side, list(families)).withColumn("family", names[F.col("feature")])
    return each.groupBy("family").agg(F.round(F.avg("psi").cast("decimal(20,10)"), 4).cast("double").alias("psi"))


def ablation_arms(families: DataFrame) -> DataFrame:
    """(arm, feature) of features(feature, family, origin): all, all but each family, and the
    features of each origin alone. An arm without features has no row."""
    kinds = families.select("family").distinct().withColumnRenamed("family", "left_out")  # some ten rows
    full = families.select(F.lit("full").alias("arm"), "feature")
    drop = families.join(F.broadcast(kinds), F.col("family") != F.col("left_out")).select(F.concat(F.lit("drop_"), "left_out").alias("arm"), "feature")
    only = families.select(F.concat("origin", F.lit("_only")).alias("arm"), "feature")
    return full.unionByName(drop).unionByName(only)


def shuffled_labels(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Labels dealt anew among the rows of each cutoff, the same in every run: the k-th row by one
    hash gets the label of the k-th by another."""
    a = Window.partitionBy("cutoff").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    b = Window.partitionBy("cutoff").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    left = rows.drop("label").withColumn("_k", F.row_number().over(a))
    right = rows.select(F.col("cutoff").alias("_c"), F.col("label"), F.row_number().over(b).alias("_n"))
    return left.join(right, (F.col("cutoff") == F.col("_c")) & (F.col("_k") == F.col("_n"))).drop("_c", "_k", "_n")


def permutation_check(train: DataFrame, test: DataFrame, score, tolerance: float = 3.0) -> DataFrame:
    """Whether a model of shuffled training labels, score(train, test), ranks the test rows no
    better than `tolerance` times the base rate."""
    got = average_precision(score(shuffled_labels(train), test), [])
    base = test.agg(F.avg(F.col("label").cast("double")).alias("base_rate"))
    out = got.crossJoin(base)  # one row by one row
    return out.select(F.col("average_precision").alias("shuffled"), F.round("base_rate", 6).alias("base_rate"), F.coalesce(F.col("average_precision") <= F.lit(tolerance) * F.col("base_rate"), F.lit(True)).alias("passes"))


def reverse_verdict(forward: float | None, backward: float | None, base_early: float, base_late: float, tolerance: float = 1.5) -> dict:
    """Lifts over each side's base rate, their ratio, and whether going back in time gains no more
    than `tolerance` times what going forward does; nothing to compare passes."""
    ahead = forward / base_late if forward and base_late else None
    back = backward / base_early if backward and base_early else None
    ratio = back / ahead if ahead and back else None
    return {"lift_forward": ahead, "lift_backward": back, "lift_ratio": ratio, "passes": ratio is None or ratio <= tolerance}


def reverse_time_check(rows: DataFrame, score, tolerance: float = 1.5) -> dict:
    """The first and the last cutoff with positives, each scored by a model of the other."""
    told = rows.groupBy("cutoff").agg(F.sum("label").alias("pos"), F.avg(F.col("label").cast("double")).alias("base")).where("pos > 0")
    ends = told.agg(F.min(F.struct("cutoff", "base")).alias("a"), F.max(F.struct("cutoff", "base")).alias("b")).first()
    if ends["a"] is None or ends["a"]["cutoff"] == ends["b"]["cutoff"]:
        return {"skipped": "two cutoffs with positives are needed", "passes": True}
    early, late = (rows.where(F.col("cutoff") == F.lit(ends[x]["cutoff"])) for x in ("a", "b"))
    ap = lambda s: average_precision(s, []).first()["average_precision"]
    return reverse_verdict(ap(score(early, late)), ap(score(late, early)), ends["a"]["base"], ends["b"]["base"], tolerance)


def resolution_delta(entities: DataFrame, outside: str = "gfw") -> DataFrame:
    """(method, n, passes): rows by how an entity was told; those told by an outside model fail."""
    return entities.groupBy("method").agg(F.count("*").alias("n")).withColumn("passes", ~F.contains(F.lower("method"), F.lit(outside)))


def gated(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """The metrics if all checks(passes) pass, else no row."""
    failed = checks.where(~F.coalesce("passes", F.lit(False))).limit(1).select(F.lit(1).alias("_failed"))
    return metrics.join(F.broadcast(failed), F.lit(True), "left_anti")


def designations_in_span(actions: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """(id, date): first addition after the first cutoff and within the horizon of the last."""
    span = cutoffs.agg(F.min("cutoff").alias("lo"), F.date_add(F.max("cutoff"), horizon).alias("hi"))
    rows = actions.where("action = 'add'").join(F.broadcast(span), (F.col("date") > F.col("lo")) & (F.col("date") <= F.col("hi")))
    return rows.groupBy("id").agg(F.min("date").alias("date"))


def flagged(s: DataFrame, terms: list, top: int = 100, drivers: int = 5) -> DataFrame:
    """The ranked top of each cutoff with the columns that drive each score: terms are columns that
    add up to it; the largest by size come first, and those of 0 don't count."""
    part = F.array(*[F.struct(F.abs(F.col(t).cast("double")).alias("size"), F.lit(t).alias("feature"), F.col(t).cast("double").alias("value")) for t in terms])
    best = F.slice(F.array_sort(F.filter(part, lambda x: x["size"] > 0), lambda a, b: F.when((a["size"] > b["size"]) | ((a["size"] == b["size"]) & (a["feature"] < b["feature"])), F.lit(-1)).otherwise(F.lit(1))), 1, drivers)
    return _ranked(s, ["cutoff"]).where(F.col("rank") <= top).withColumn("drivers", F.transform(best, lambda x: F.concat_ws("=", x["feature"], F.format_string("%.3f", x["value"]))))


def review_sheet(s: DataFrame, top: int = 20) -> DataFrame:
    """The best-ranked rows of each quarter that aren't positives, each id once, for a reader to judge."""
    q = _ranked(s, ["cutoff"]).where("label = 0").withColumn("quarter", F.concat(F.year("cutoff").cast("string"), F.lit("-Q"), F.quarter("cutoff").cast("string")))
    once = q.withColumn("_n", F.row_number().over(Window.partitionBy("quarter", "id").orderBy("rank", "cutoff"))).where("_n = 1")
    order = Window.partitionBy("quarter").orderBy("rank", "cutoff", "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("_n")


def forward_list(s: DataFrame, top: int = 50) -> DataFrame:
    """The ranked top of each cutoff with the digest of the whole list. A list whose scores are all
    equal predicts nothing: its cutoff has no row."""
    listed = _ranked(s, ["cutoff"]).where(F.col("rank") <= top)
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.concat_ws(",", F.col("rank").cast("string"), F.col("id").cast("string"), F.format_string("%.6f", "score")).alias("line"))))
    digest = listed.groupBy("cutoff").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), 256).alias("sha256"), F.count_distinct(F.round("score", 6)).alias("_kinds"))
    return listed.join(digest.where("_kinds > 1").drop("_kinds"), "cutoff")


def commit_list(store, listed: DataFrame) -> None:
    """Adds lists to the store's table `forward`; a cutoff that is there already is never replaced."""
    if store.exists("forward"):
        there = store.read("forward").select(F.col("dt").alias("_dt")).distinct()
        if listed.join(F.broadcast(there), F.col("cutoff").cast("string") == F.col("_dt"), "left_semi").limit(1).count():
            raise ValueError("a committed list can't be replaced")
    store.write(listed.withColumn("dt", F.col("cutoff").cast("string")), "forward", order=("rank",))


def evaluate_forward(listed: DataFrame, actions: DataFrame, as_of: str, horizon: int, top: int = 50) -> DataFrame:
    """Per cutoff: rows, additions by `as_of` within the horizon, median days to them, and whether
    the digest still is that of the rows. Raises where it isn't."""
    again = forward_list(listed.drop("rank", "sha256"), top).groupBy("cutoff").agg(F.first("sha256").alias("now"))
    if listed.join(again, "cutoff", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).limit(1).count():
        raise ValueError("a list is not the one whose digest was committed")
    adds = actions.where("action = 'add'").select(F.col("id").alias("_id"), "date").where(F.col("date") <= F.lit(as_of).cast("date"))
    hit = listed.join(adds, (F.col("id") == F.col("_id")) & (F.col("date") > F.col("cutoff")) & (F.col("date") <= F.date_add("cutoff", horizon)), "left")
    hit = hit.groupBy("cutoff", "id").agg(F.datediff(F.min("date"), F.first("cutoff")).alias("days"))
    return hit.groupBy("cutoff").agg(F.count("*").alias("listed"), F.count("days").alias("designated"), F.percentile("days", 0.5).alias("median_lead_days"))
