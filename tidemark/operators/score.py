"""Rules, ranking metrics, drift and agreement. Rows are (cutoff, id, score, label)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of the weighted rule, by term.
POINTS = {"b1": 3.0, "gap_hours": 2.0, "partner": 2.0, "flag": 1.0, "age": 1.0, "names": 1.0, "excess": 1.0}


def rule_terms(f: DataFrame) -> DataFrame:
    """f has visits, share, gap_hours, partners, convenience, age, names, excess; null is 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.withColumns({
        "t_b1": ((z("visits") > 0) | (z("share") > 0)).cast("int"),
        "t_gap_hours": (z("gap_hours") > 24).cast("int"),
        "t_partner": (z("partners") > 0).cast("int"),
        "t_flag": (z("convenience") > 0).cast("int"),
        "t_age": (z("age") > 15).cast("int"),
        "t_names": (z("names") >= 1).cast("int"),
        "t_excess": (z("excess") > 0).cast("int"),
    })


def rule_scores(f: DataFrame) -> DataFrame:
    """Adds b1 (0 or 1) and b2, the weighted sum of terms."""
    total = F.lit(0.0)
    for name, points in POINTS.items():
        total = total + F.col(f"t_{name}") * F.lit(points)
    return rule_terms(f).withColumn("b1", F.col("t_b1").cast("double")).withColumn("b2", total)


def _ranked(s: DataFrame, by: list) -> DataFrame:
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def at_k(s: DataFrame, k: int, by=("cutoff",)) -> DataFrame:
    """precision, recall, false positive rate at k (at most all rows) and the alerts that half of
    the positives need; null where there are no positives (or no negatives)."""
    by = list(by)
    hits = Window.partitionBy(*by).orderBy("rank")
    r = _ranked(s, by).withColumn("hits", F.sum("label").over(hits)).withColumn("pos", F.sum("label").over(Window.partitionBy(*by)))
    g = r.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("pos").alias("n_pos"), F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias("tp"),
        F.min(F.when((F.col("hits") * 2 >= F.col("pos")) & (F.col("pos") > 0), F.col("rank"))).alias("alerts_half"),
    )
    top = F.least(F.lit(k), F.col("n"))
    return g.select(
        *by, "n", "n_pos", F.when(F.col("n_pos") > 0, F.round(F.col("tp") / top, 6)).alias("precision"), F.when(F.col("n_pos") > 0, F.round(F.col("tp") / F.col("n_pos"), 6)).alias("recall"),
        F.when(F.col("n") > F.col("n_pos"), F.round((top - F.col("tp")) / (F.col("n") - F.col("n_pos")), 6)).alias("fpr"), "alerts_half",
    )


def average_precision(s: DataFrame, by=("cutoff",)) -> DataFrame:
    """Sum over distinct scores, from the top, of the gain in recall times the precision there; null
    where there are no positives."""
    by = list(by)
    g = s.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    g = g.withColumns({"tp": F.sum("p").over(w), "n": F.sum("c").over(w), "pos": F.sum("p").over(Window.partitionBy(*by))})
    return g.groupBy(*by).agg(F.round(F.sum(F.when(F.col("pos") > 0, F.col("p") / F.nullif("pos", F.lit(0)) * F.col("tp") / F.col("n"))), 6).alias("average_precision"))


def brier(s: DataFrame, by=("cutoff",)) -> DataFrame:
    return s.groupBy(*by).agg(F.round(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))), 6).alias("brier"))


def psi(df: DataFrame, side: str, features: list, *, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """(feature, psi) between rows with side 0, which give the quantile bins, and side 1; null where
    either side has no rows. Features and bins are few, so edges are broadcast."""
    long = df.unpivot([side], features, "feature", "value").where("value is not null")
    steps = [i / bins for i in range(1, bins)]
    edges = long.where(F.col(side) == 0).groupBy("feature").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(x) for x in steps]))).alias("edges"))
    binned = long.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    n = binned.groupBy("feature", "edges", "bin").agg(F.count(F.when(F.col(side) == 0, 1)).alias("a"), F.count(F.when(F.col(side) == 1, 1)).alias("b"))
    w = Window.partitionBy("feature")
    pa, pb = (F.when(F.sum(c).over(w) > 0, F.greatest(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(eps))) for c in ("a", "b"))
    return n.withColumn("part", (pb - pa) * F.log(pb / pa)).groupBy("feature").agg(F.round(F.sum("part"), 4).alias("psi"))


def kappa(pairs: DataFrame) -> DataFrame:
    """pairs(a, b): raw agreement and Cohen's kappa, null if one category is all there is."""
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows, cols = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy(F.col("b").alias("cb")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, F.col("a") == F.col("cb")).agg(F.sum(F.col("ra").cast("double") * F.col("rb")).alias("e"))
    total = n.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    out = total.join(F.broadcast(chance)).withColumn("po", F.col("same") / F.col("total")).withColumn("pe", F.coalesce("e", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total")))
    return out.select("total", F.round("po", 6).alias("agreement"), F.when(F.col("pe") < 1, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).alias("kappa"))


def macro_average(metrics: DataFrame, by: list, values: list) -> DataFrame:
    """Mean over cutoffs of each metric, leaving out nulls."""
    return metrics.groupBy(*by).agg(*[F.round(F.avg(v), 4).alias(v) for v in values], F.count("*").alias("n_cutoffs"))


def strata(s: DataFrame) -> DataFrame:
    """Each row once in stratum all, and in first_seen at the first cutoff of its id."""
    first = F.min("cutoff").over(Window.partitionBy("id"))
    out = s.withColumn("stratum", F.when(F.col("cutoff") == first, F.array(F.lit("all"), F.lit("first_seen"))).otherwise(F.array(F.lit("all"))))
    return out.withColumn("stratum", F.explode("stratum"))


def watchlist(s: DataFrame, top: int) -> DataFrame:
    """The ranked top of each cutoff."""
    return _ranked(s, ["cutoff"]).where(F.col("rank") <= top)


def list_violations(lists: DataFrame) -> DataFrame:
    """Rows of watch lists (cutoff, rank, id, score) that break the contract: ranks from 1 without
    gaps, scores that never rise, ids once."""
    w = Window.partitionBy("cutoff").orderBy("rank", "id")
    seen = lists.withColumns({"_n": F.row_number().over(w), "_was": F.lag("score").over(w), "_many": F.count("*").over(Window.partitionBy("cutoff", "id"))})
    broken = F.when(F.col("rank") != F.col("_n"), "rank").when(F.col("score") > F.col("_was"), "score").when(F.col("_many") > 1, "repeated")
    return seen.withColumn("broken", broken).where("broken is not null").drop("_n", "_was", "_many")


def usable_history(cutoffs: DataFrame, horizon: int) -> DataFrame:
    """(cutoff, past) of the cutoffs whose labels are known by a later one."""
    a, b = cutoffs.select("cutoff"), cutoffs.select(F.col("cutoff").alias("past"))
    return a.join(F.broadcast(b), F.date_add("past", horizon) <= F.col("cutoff"))


def hashed_scores(s: DataFrame, seed: int) -> DataFrame:
    """Scores without information, the same in every run."""
    return s.withColumn("score", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)))
