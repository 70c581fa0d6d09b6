"""Walk-forward gradient-boosted trees on assembled features."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.labels import split_folds


@dataclass(frozen=True)
class ModelConfig:
    iterations: int = 200
    depth: int = 5
    rate: float = 0.05
    threshold: float = 0.5
    seed: int = 42


def balanced(train: DataFrame) -> DataFrame:
    """+ weight: n / (2 n_class), so both classes weigh alike."""
    n = train.groupBy("target").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    return train.join(F.broadcast(n.crossJoin(total)), "target").withColumn("weight", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")


def fit(train: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig()):
    """A pipeline model (assembler and trees); rows with a null feature are skipped when scored."""
    trees = GBTClassifier(
        featuresCol="features", labelCol="target", weightCol="weight", maxIter=cfg.iterations, maxDepth=cfg.depth, stepSize=cfg.rate, maxBins=64, seed=cfg.seed
    )
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, trees]).fit(balanced(train))


def score(model, rows: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """+ proba, predicted."""
    scored = model.transform(rows).withColumn("proba", vector_to_array("probability")[1])
    return scored.withColumn("predicted", (F.col("proba") >= cfg.threshold).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def walk_forward(data: DataFrame, folds: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig(), parts: tuple[str, ...] = ("test",)) -> DataFrame:
    """Scored rows of all folds: data + fold_id, proba, predicted; out-of-sample ones, or with more ``parts`` (train, test)
    each fold's, and their part. Every fit is distributed; folds follow one another, as there are a handful."""
    tagged = split_folds(data, folds)
    out = None
    for (k,) in folds.select("fold_id").orderBy("fold_id").collect():  # a handful of ids
        own = tagged.where(F.col("fold_id") == k)
        made = score(fit(own.where("part = 'train'"), features, cfg), own.where(F.col("part").isin(*parts)), cfg)
        out = made if out is None else out.unionByName(made)
    return out if len(parts) > 1 else out.drop("part")


def score_latest(model, rows: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig(), time: str = "ts") -> DataFrame:
    """(symbol, predicted, proba) for the last row of each symbol; (0, null) where a feature is missing."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct(*features), time).alias("x")).select("symbol", "x.*")
    done = score(model, last.dropna(subset=features), cfg).select("symbol", "predicted", "proba")
    return last.select("symbol").join(done, "symbol", "left").select("symbol", F.coalesce("predicted", F.lit(0)).alias("predicted"), "proba")


def save_model(model, path: str) -> None:
    """The pipeline model at ``path``, over an earlier one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def in_and_out_of_sample(data: DataFrame, folds: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """(fold_id, part, n, accuracy, n_signals, mean_return): of every fold the rows it was fitted on beside those held out.

    data: target, the features, realized_return. A large gap between the parts is a sign of overfitting.
    """
    made = walk_forward(data, folds, features, cfg, ("train", "test"))
    signal = F.when(F.col("predicted") == 1, F.col("realized_return"))
    return made.groupBy("fold_id", "part").agg(
        F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"),
        F.sum("predicted").alias("n_signals"), F.avg(signal).alias("mean_return"),
    )
