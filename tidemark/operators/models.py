"""Models of feature rows (cutoff, id, numeric features, label)."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def design(df: DataFrame, features: list) -> DataFrame:
    """Features in the order of their names, null as 0, as vector `x`."""
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=sorted(features), outputCol="x").transform(filled)


def _balanced(train: DataFrame) -> DataFrame | None:
    n, pos = train.agg(F.count("*"), F.sum("label")).first()
    if not pos or pos == n:
        return None
    return train.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))


def logistic(train: DataFrame, test: DataFrame, features: list) -> DataFrame:
    """test with score and contributions (each feature's share of the logit): standardised, classes
    balanced; score 0 where there is nothing to learn."""
    weighted = _balanced(train)
    if weighted is None:
        return test.withColumn("score", F.lit(0.0)).withColumn("contributions", F.lit(None).cast("array<double>"))
    steps = [StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", weightCol="weight", regParam=1e-3, maxIter=100)]
    model = Pipeline(stages=steps).fit(design(weighted, features))
    w = F.array(*[F.lit(float(c)) for c in model.stages[1].coefficients])
    out = model.transform(design(test, features))
    parts = F.zip_with(vector_to_array("z"), w, lambda a, b: a * b)
    return out.select(*test.columns, F.element_at(vector_to_array("probability"), 2).alias("score"), parts.alias("contributions"))


def boosted(train: DataFrame, test: DataFrame, features: list, seeds=(1, 2, 3)) -> DataFrame:
    """test with score: the mean of boosted trees of some seeds, which stop by the last cutoff."""
    weighted = _balanced(train)
    if weighted is None:
        return test.withColumn("score", F.lit(0.0))
    last = F.max("cutoff").over(Window.partitionBy(F.lit(0)))
    x = design(weighted, features).withColumn("held", F.col("cutoff") == last)
    if x.where("not held").agg(F.count_distinct("label")).first()[0] < 2:
        x = x.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    out = design(test, features)
    for s in seeds:
        m = GBTClassifier(featuresCol="x", weightCol="weight", validationIndicatorCol="held", maxIter=40, maxDepth=4, stepSize=0.1, seed=s).fit(x)
        m.setPredictionCol(f"_p{s}").setRawPredictionCol(f"_r{s}").setProbabilityCol(f"_q{s}")
        out = m.transform(out).withColumn(f"_s{s}", F.element_at(vector_to_array(f"_q{s}"), 2))
    return out.select(*test.columns, (sum((F.col(f"_s{s}") for s in seeds), F.lit(0.0)) / len(seeds)).alias("score"))


def isolation_forest(df: DataFrame, features: list, *, trees: int = 200, sample: int = 256, seed: int = 7) -> DataFrame:
    """(cutoff, id, score) by isolation trees of each cutoff: the shorter a row's mean path, the
    higher. Trees are grown from samples of each cutoff by hash, `trees` times `sample` rows at
    most; all rows are then scored in Arrow batches, so no cutoff is gathered in one task. Zeros
    for a cutoff of fewer than ten rows."""
    names = sorted(features)
    x = df.select("cutoff", "id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
    w = Window.partitionBy("cutoff", "_tree").orderBy("_h", "id")
    drawn = x.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", F.xxhash64("id", "_tree", F.lit(seed)))
    drawn = drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        data, rng = pdf[names].to_numpy(), np.random.default_rng(seed * 1000 + int(pdf["_tree"].iloc[0]))
        nodes, todo = [], [(np.arange(len(data)), 0, -1, 0)]
        deepest = int(np.ceil(np.log2(max(2, len(data)))))
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            low, high = data[rows].min(axis=0), data[rows].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) <= 1 or not len(open_):
                nodes.append([-1, 0.0, 0, 0, depth + _mean_path(len(rows))])
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(low[f], high[f])
            nodes.append([f, at, 0, 0, 0.0])
            left = data[rows, f] < at
            todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
        return pd.DataFrame({"cutoff": pdf["cutoff"].iloc[:1], "nodes": [[float(v) for n in nodes for v in n]], "n": [len(data)]})

    forest = drawn.groupBy("cutoff", "_tree").applyInPandas(grow, f"cutoff {x.schema['cutoff'].dataType.simpleString()}, nodes array<double>, n bigint")
    forest = forest.groupBy("cutoff").agg(F.collect_list("nodes").alias("trees"), F.max("n").alias("n"))
    grown = {str(r["cutoff"]): (r["trees"], r["n"]) for r in forest.collect()}  # bounded by trees and sample

    def run(frames):
        for pdf in frames:
            score = np.zeros(len(pdf))
            for cutoff, part in pdf.reset_index(drop=True).groupby(pdf["cutoff"].astype(str).to_numpy()):
                grown_trees, n = grown[cutoff]
                if n < 10:
                    continue
                data, total = part[names].to_numpy(), np.zeros(len(part))
                for t in grown_trees:
                    t = np.array(t).reshape(-1, 5)
                    at = np.zeros(len(part), np.int64)
                    while (go := t[at, 0] >= 0).any():
                        f = t[at, 0].astype(np.int64)
                        right = data[np.arange(len(part)), np.maximum(f, 0)] >= t[at, 1]
                        at = np.where(go, np.where(right, t[at, 3], t[at, 2]).astype(np.int64), at)
                    total += t[at, 4]
                score[part.index] = 2.0 ** (-total / len(grown_trees) / _mean_path(n))
            yield pdf[["cutoff", "id"]].assign(score=score)

    return x.mapInPandas(run, f"cutoff {x.schema['cutoff'].dataType.simpleString()}, id {x.schema['id'].dataType.simpleString()}, score double")


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0
