"""Quality classifier: naive Bayes support vectors over byte n-gram indicators."""

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import SPACE_WORDS, WordHasher, bytes_of, small_batches

_WORDS = WordHasher(SPACE_WORDS)


@dataclass(frozen=True)
class QualityConfig:
    #: Lengths of the n-grams of bytes, and the number of indicators they are hashed to (a power of two).
    grams: tuple[int, ...] = (2, 3)
    buckets: int = 1 << 16
    #: The fit takes at most so many labelled rows of either class, by a hash of doc_id; scoring takes all rows.
    rows_per_class: int = 2000
    #: Additive smoothing of the counts, soft-margin cost, passes of coordinate descent, folds of the calibration.
    alpha: float = 1.0
    cost: float = 10.0
    #: Added to a row's squared length before it is scaled to unit length, so a few n-grams don't weigh like thousands.
    shrink: float = 50.0
    #: Word distances at which a text's own words are looked for again, and the repeats that set an indicator.
    echoes: tuple[int, ...] = (1, 2, 3)
    repeats: tuple[int, ...] = (2, 4)
    passes: int = 12
    folds: int = 3
    threshold: float = 0.7
    seed: int = 5


def indicators(text: bytes, cfg: QualityConfig) -> np.ndarray:
    """Buckets of the n-grams that the whole text has, ascending.

    Besides the byte n-grams there are back-referring word n-grams ("w w", "w . w", ...: a word that comes again at
    that distance), each set where the text has it often enough.
    """
    present = np.zeros(cfg.buckets, dtype=bool)
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - cfg.buckets.bit_length() + 1)
    for n in cfg.grams:
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n, dtype=np.uint32)
        for j in range(n):
            h = (h + b[j : len(b) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        present[(h * np.uint32(0x85EBCA77)) >> shift] = True
    if len(b):
        _, _, words = _WORDS(np.frombuffer(text, dtype=np.uint8))
        for i, k in enumerate(cfg.echoes):
            count = int((words[k:] == words[:-k]).sum())
            for j, least in enumerate(cfg.repeats):
                if count >= least:
                    present[cfg.buckets - 1 - i * len(cfg.repeats) - j] = True
    return np.flatnonzero(present)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    """r = log of the share of class 1 over that of class -1, for every indicator."""
    p, q = np.full(cfg.buckets, cfg.alpha), np.full(cfg.buckets, cfg.alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    """Linear hinge-loss model (Hsieh et al. 2008) with a constant feature last; rows are sparse, at most of unit length."""
    rng = np.random.default_rng(cfg.seed)
    w, a = np.zeros(cfg.buckets + 1), np.zeros(len(rows))
    # Both classes weigh alike whatever their numbers.
    cost = cfg.cost * len(y) / 2 / np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1))
    for _ in range(cfg.passes):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(a[i] - g / (v @ v + 1), 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[x] += step * v
                w[-1] += step
                a[i] = new
    return w


def _scaled(x: np.ndarray, r: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    v = r[x]
    return v / np.sqrt(v @ v + cfg.shrink)


@dataclass(frozen=True)
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    cfg: QualityConfig

    def score(self, text: bytes) -> float:
        x = indicators(text, self.cfg)
        value = float(self.weights[x] @ _scaled(x, self.ratios, self.cfg) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30))))


def _calibration(value: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Platt's sigmoid by Newton's method on softened targets; then moved to the class shares of all labelled rows."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, beta = np.stack([value, np.ones_like(value)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    shown = up / max(up + down, 1)
    return float(beta[0]), float(beta[1] + np.log(prior / (1 - prior)) - np.log(shown / (1 - shown)))


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """labels 0/1; prior: share of label 1 in all rows that may be learned from. With one class only, every score is
    that class's; without rows, 0.5."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        offset = 0.0 if not len(y) else 3.0 * float(y[0])
        return QualityModel(np.zeros(cfg.buckets), np.zeros(cfg.buckets + 1), 0.0, offset, cfg)

    def model(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = log_count_ratios([rows[i] for i in at], y[at], cfg)
        part = [rows[i] for i in at]
        return r, dual_coordinate_descent(part, [_scaled(x, r, cfg) for x in part], y[at], cfg)

    fold, held = np.arange(len(y)) % cfg.folds, np.zeros(len(y))
    for k in range(cfg.folds):
        at = np.flatnonzero(fold != k)
        if len(set(y[at].tolist())) < 2:
            continue
        r, w = model(at)
        for i in np.flatnonzero(fold == k):
            held[i] = w[rows[i]] @ _scaled(rows[i], r, cfg) + w[-1]
    slope, offset = _calibration(held, y, prior)
    r, w = model(np.arange(len(y)))
    return QualityModel(r, w, slope, offset, cfg)


def remainder(key: str, m: int) -> F.Column:
    """crc32 of the id's text, mod m; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % m


def train_quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on rows of ``docs`` labelled in ``labels`` whose remainder mod 4 is not 2 (label, id: choice of rows only).

    The ids of the sample are chosen on the narrow label table and are few, so they are broadcast; only indicators of
    the sampled texts come to the driver (cfg.rows_per_class bounds both). Labels that contradict each other for
    one id, null labels and null ids are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_hi"))
        .where("label = _hi").where(remainder("doc_id", 4) != 2).select("doc_id", "label")
    )
    shares = {r["label"]: r["count"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.where("label > 0").orderBy(*by_hash).limit(cfg.rows_per_class).unionByName(
        known.where("label <= 0").orderBy(*by_hash).limit(cfg.rows_per_class)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t, cfg).astype(np.uint32).tobytes() for t in bytes_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id",)} | {"label": known.schema["label"].dataType.simpleString()}
    # Repeated documents repeat in the sample, each id at most so often as the bound allows.
    got = (
        sample.mapInArrow(run, f"doc_id {kinds['doc_id']}, label {kinds['label']}, x binary")
        .dropDuplicates(["doc_id", "x"]).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * cfg.rows_per_class).toArrow().to_pydict()
    )
    order = sorted(range(len(got["doc_id"])), key=lambda i: (hash_order(got["doc_id"][i]), got["x"][i]))
    rows = [np.frombuffer(got["x"][i], dtype=np.uint32).astype(np.int64) for i in order]
    y = np.array([got["label"][i] for i in order])
    total = sum(shares.values())
    prior = min(max(shares.get(1, 0) / total, 0.01), 0.99) if total else 0.5
    return fit(rows, y, prior, cfg)


def hash_order(key) -> int:
    """A fixed shuffle of the training rows, whatever order they arrive in."""
    return zlib.crc32(f"order {key}".encode())


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score (double) and predicted (1 if score reaches the threshold), from the whole text alone.

    Null text scores as empty text: the model's constant. Very long texts count whole; repeated rows score alike; an
    empty table gives no rows. Other columns pass through, but score and predicted are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.coalesce(F.col("text"), F.lit("")))).withColumn(
        "predicted", F.when(F.col("score") >= model.cfg.threshold, 1).otherwise(0)
    )
