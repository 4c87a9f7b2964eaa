"""The learned matcher: training sets, folds, boosted trees, predictions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.decide import best_of_target
from kinfold.operators.features import FEATURES
from kinfold.operators.scoring import ASSIGNED_GRID, best_threshold, sweep


@dataclass(frozen=True)
class Trees:
    """Boosted trees; ``patience`` (an improvement below ``least_gain`` ends boosting) uses a held-out part."""

    rounds: int = 60
    depth: int = 6
    rate: float = 0.1
    share: float = 0.8
    least_rows: int = 5
    features: str = "0.8"
    least_gain: float = 0.001
    seed: int = 42


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Append y: 1 where the pair is true."""
    return pairs.join(truth.select("s1", "t").distinct().withColumn("y", F.lit(1)), ["s1", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def training_pairs(candidates: DataFrame, truth: DataFrame, ratio: int | None = 5, seed: int = 0) -> DataFrame:
    """(s1, t, y): candidates and true pairs; of a query's false pairs at most ``ratio`` times its true ones.

    A query without true pairs gives no false ones. Which are kept goes by a seeded hash.
    """
    everything = candidates.select("s1", "t").unionByName(truth.select("s1", "t")).distinct()
    d = labelled(everything, truth)
    if ratio is None:
        return d
    by = Window.partitionBy("s1", "y").orderBy(F.xxhash64(F.lit(seed), "s1", "t"), "t")
    d = d.withColumn("n", F.row_number().over(by)).withColumn("pos", F.sum("y").over(Window.partitionBy("s1")))
    return d.filter((F.col("y") == 1) | (F.col("n") <= ratio * F.col("pos"))).select("s1", "t", "y")


def sampled_queries(candidates: DataFrame, country: DataFrame, most: int = 300_000, seed: int = 0) -> DataFrame:
    """The candidates of at most ``most`` queries a country, whole; by a seeded hash."""
    ids = candidates.select("s1").distinct().join(country, "s1").withColumn("n", F.row_number().over(Window.partitionBy("country").orderBy(F.xxhash64(F.lit(seed), "s1"), "s1")))
    return candidates.join(ids.filter(F.col("n") <= most).select("s1"), "s1", "left_semi")


def fold(folds: int, seed: int = 0) -> Column:
    """Which fold a query's pairs are in, all of them together."""
    return F.pmod(F.xxhash64(F.lit(seed), "s1"), F.lit(folds)).cast("int")


def fit(train: DataFrame, spec: Trees = Trees(), features: list[str] = FEATURES, validation: str | None = None) -> PipelineModel:
    """Trees over ``features`` and ``y``; with ``validation`` (a boolean column) boosting stops early."""
    g = GBTClassifier(labelCol="y", featuresCol="x", maxIter=spec.rounds, maxDepth=spec.depth, stepSize=spec.rate, subsamplingRate=spec.share, minInstancesPerNode=spec.least_rows, featureSubsetStrategy=spec.features, validationTol=spec.least_gain, seed=spec.seed, cacheNodeIds=False)
    if validation:
        g = g.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep"), g]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(s1, t, p)."""
    return model.transform(df).select("s1", "t", vector_to_array("probability")[1].alias("p"))


def out_of_fold(train: DataFrame, folds: int = 3, spec: Trees = Trees(), features: list[str] = FEATURES) -> tuple[DataFrame, list[int]]:
    """Predictions for every pair by a model that did not see its query, and each model's number of trees."""
    d = train.withColumn("fold", fold(folds))
    out, rounds = None, []
    for k in range(folds):
        rest = d.filter(F.col("fold") != k).withColumn("held", F.pmod(F.xxhash64(F.lit(1), "s1"), F.lit(10)) == 0)
        model = fit(rest, spec, features, "held")
        rounds.append(model.stages[-1].getNumTrees)
        own = predict(model, d.filter(F.col("fold") == k))
        out = own if out is None else out.unionByName(own)
    return out, rounds


@dataclass(frozen=True)
class Meta:
    """What is kept beside a model."""

    pairs: int
    threshold: float
    rounds: int
    oof_f05: float | None = None
    fold_rounds: tuple[int, ...] = ()

    def facts(self) -> dict:
        return asdict(self)


def train(data: DataFrame, truth: DataFrame, folds: int = 3, spec: Trees = Trees(), threshold: float = 0.70, features: list[str] = FEATURES) -> tuple[PipelineModel, Meta]:
    """The final model and its description.

    With folds the threshold is the best of a sweep over out-of-fold scores, each target given to its
    best query, and the number of trees a tenth above the folds' mean; without, both are as given.
    """
    n, oof = data.count(), None
    rounds: list[int] = []
    if folds >= 2:
        scored, rounds = out_of_fold(data, folds, spec, features)
        s1 = data.select(F.col("s1").alias("entity_id")).distinct()
        best = best_threshold(sweep(best_of_target(scored), truth.join(data.select("s1").distinct(), "s1", "left_semi"), s1, ASSIGNED_GRID, "p")).first()
        threshold, oof = best.threshold, best.macro_f05
        spec = Trees(**{**asdict(spec), "rounds": max(1, int(sum(rounds) / len(rounds) * 1.1))})
    return fit(data, spec, features), Meta(n, threshold, spec.rounds, oof, tuple(rounds))


def importances(model: PipelineModel, features: list[str] = FEATURES, most: int = 15) -> list[tuple[str, float]]:
    """The features that the trees gain most by."""
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, v.tolist()), key=lambda x: (-x[1], x[0]))[:most]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
