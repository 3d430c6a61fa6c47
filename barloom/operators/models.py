"""Ensemble learning with spark.ml: fit, stack, score, evaluate, rank features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.datasets import assign, weighted

C = F.col


@dataclass(frozen=True)
class ModelConfig:
    trees: int = 100
    depth: int = 8
    rounds: int = 50
    boost_depth: int = 5
    seed: int = 42


def preparation(columns: list[str]) -> list:
    """Vector in column order, then standardised; fitted on training rows only."""
    return [VectorAssembler(inputCols=columns, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="vector", withMean=True)]


def forest(cfg: ModelConfig) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=cfg.trees,
                                  maxDepth=cfg.depth, seed=cfg.seed, probabilityCol="forest_p",
                                  rawPredictionCol="forest_raw", predictionCol="forest_label")


def boosted(cfg: ModelConfig, valid: str | None = None) -> GBTClassifier:
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=cfg.rounds,
                          maxDepth=cfg.boost_depth, seed=cfg.seed, predictionCol="boost_label")
    model = model.setProbabilityCol("boost_p").setRawPredictionCol("boost_raw")
    return model.setValidationIndicatorCol(valid) if valid else model


def fit(df: DataFrame, columns: list[str], cfg: ModelConfig = ModelConfig(), valid: str | None = None) -> PipelineModel:
    """Scaler, forest and boosted trees in one model. `valid` flags rows for early stopping."""
    train = weighted(df)
    return Pipeline(stages=[*preparation(columns), forest(cfg), boosted(cfg, valid)]).fit(train)


def fit_target(df: DataFrame, columns: list[str], cfg: ModelConfig = ModelConfig()) -> PipelineModel:
    """Boosted regression of the forward Sharpe target."""
    tree = GBTRegressor(featuresCol="vector", labelCol="target", maxIter=cfg.rounds, maxDepth=cfg.boost_depth,
                        seed=cfg.seed, predictionCol="sharpe")
    return Pipeline(stages=[*preparation(columns), tree]).fit(df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """forest_prob and boost_prob of each row."""
    out = model.transform(df)
    return out.withColumns({"forest_prob": vector_to_array("forest_p")[1],
                            "boost_prob": vector_to_array("boost_p")[1]}).select(*df.columns, "forest_prob", "boost_prob")


def out_of_fold(df: DataFrame, columns: list[str], k: int = 4, purge: int = 10,
                cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Test-side predictions of every fold, each from a model fitted on that fold's training side."""
    rows = assign(df, k, purge).persist()  # read by every stage of every fold
    parts = [score(fit(rows.filter((C("fold") == f) & (C("side") == "train")), columns, cfg),
                   rows.filter((C("fold") == f) & (C("side") == "test"))) for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


META = ["forest_prob", "boost_prob"]


def stack(oof: DataFrame) -> PipelineModel:
    """Logistic regression on out-of-fold member probabilities."""
    meta = LogisticRegression(featuresCol="meta", labelCol="label", probabilityCol="meta_p",
                              rawPredictionCol="meta_raw", predictionCol="meta_label")
    return Pipeline(stages=[VectorAssembler(inputCols=META, outputCol="meta"), meta]).fit(oof)


def stacked(model: PipelineModel, scored: DataFrame) -> DataFrame:
    return model.transform(scored).withColumn("prob", vector_to_array("meta_p")[1]).select(*scored.columns, "prob")


def auc(df: DataFrame, prob: str = "prob", by: tuple = (), bits: int = 14) -> DataFrame:
    """Rank-sum AUC and accuracy at one half, per group.

    Scores are counted per value first; ranks come from a prefix over score buckets and an ordered
    pass within each, so no task orders all scores.
    """
    by = list(by)
    vals = df.groupBy(*by, C(prob).alias("_p")).agg(
        F.count_if(C("label") == 1).alias("_pos"), F.count_if(C("label") == 0).alias("_neg"))
    vals = vals.withColumn("_b", F.floor(C("_p") * (1 << bits)))
    prior = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = vals.groupBy(*by, "_b").agg(F.sum("_neg").alias("_bn")).withColumn(
        "_before", F.coalesce(F.sum("_bn").over(prior), F.lit(0))).drop("_bn")
    inside = Window.partitionBy(*by, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    vals = vals.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(buckets, [*by, "_b"])
    hits = F.sum(F.when(C("_p") >= 0.5, C("_pos")).otherwise(C("_neg")))
    wins = F.sum(C("_pos") * (C("_before") + C("_in") + C("_neg") * 0.5))
    pairs = F.sum("_pos") * F.sum("_neg")
    return vals.groupBy(*by).agg(
        F.when(pairs > 0, wins / pairs).alias("auc"),
        (hits / F.sum(C("_pos") + C("_neg"))).alias("accuracy"), F.sum(C("_pos") + C("_neg")).alias("n"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population spread of the AUC over folds."""
    return folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("spread"))


def importances(model: PipelineModel, columns: list[str], top: int = 5) -> DataFrame:
    """Largest mean importances of the tree members (as many rows as features)."""
    from pyspark.sql import SparkSession

    trees = [s.featureImportances.toArray() for s in model.stages if hasattr(s, "featureImportances")]
    mean = sum(trees) / len(trees)
    rows = [(name, float(v)) for name, v in zip(columns, mean)]
    df = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def target_correlation(df: DataFrame, a: str = "sharpe", b: str = "target") -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))


def with_sequence_scores(scored: DataFrame, sequence: DataFrame, neutral: float = 0.5) -> DataFrame:
    """External sequence scores by (symbol, ts), neutral where missing, with `matched` 1/0."""
    out = scored.join(sequence.select("symbol", "ts", C("seq_prob")), ["symbol", "ts"], "left")
    return out.withColumn("matched", C("seq_prob").isNotNull().cast("int")).withColumn(
        "seq_prob", F.coalesce("seq_prob", F.lit(neutral)))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
