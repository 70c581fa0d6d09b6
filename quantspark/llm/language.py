"""Language identification: a byte convolutional network trained in numpy."""

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import bytes_of, groups_of_texts, small_batches
from quantspark.llm.quality import remainder


@dataclass(frozen=True)
class LanguageConfig:
    #: Bytes of a window; widths of the filters and filters of each width.
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    #: The fit takes at most so many documents of each language, by a hash of doc_id, and windows of each document.
    docs_per_language: int = 600
    windows_per_doc: int = 4
    epochs: int = 4
    batch: int = 64
    rate: float = 3e-3
    seed: int = 3


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def windows(text: bytes, size: int) -> np.ndarray:
    """The whole text in consecutive windows, A-Z folded, the last one filled up with zeros: (n, size) uint8."""
    n = -(-len(text) // size)
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(text)] = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    return out.reshape(n, size)


class ByteConvNet:
    """One-hot bytes -> filters of several widths -> maximum over the window -> rectifier -> softmax.

    A filter over one-hot bytes is a sum of table rows, one table for each place in the filter, so the forward pass
    gathers rows instead of multiplying, and only the winning place of a filter gets a gradient.
    """

    def __init__(self, languages: list[str], cfg: LanguageConfig) -> None:
        rng = np.random.default_rng(cfg.seed)
        self.cfg, self.languages = cfg, languages
        self.tables = [rng.normal(0, 0.3, (w, 256, cfg.filters)).astype(np.float32) for w in cfg.widths]
        self.bias = np.zeros(len(cfg.widths) * cfg.filters, dtype=np.float32)
        self.out = rng.normal(0, 0.2, (len(cfg.widths) * cfg.filters, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of every filter over each window, and where it is."""
        top, places = [], []
        for t in self.tables:
            w = len(t)
            z = t[0][x[:, : x.shape[1] - w + 1]]
            for o in range(1, w):
                z += t[o][x[:, o : x.shape[1] - w + 1 + o]]
            at = z.argmax(axis=1)
            places.append(at)
            top.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(top, axis=1) + self.bias, places

    def peak(self, x: np.ndarray) -> np.ndarray:
        """As pooled(), without the places."""
        top = []
        for t in self.tables:
            w = len(t)
            z = t[0][x[:, : x.shape[1] - w + 1]]
            for o in range(1, w):
                z += t[o][x[:, o : x.shape[1] - w + 1 + o]]
            top.append(z.max(axis=1))
        return np.concatenate(top, axis=1) + self.bias

    def log_probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), dtype=np.float32)
        for i in range(0, len(x), step):
            z = np.maximum(self.peak(x[i : i + step]), 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[i : i + step] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray) -> "ByteConvNet":
        """Adam on the cross-entropy, languages weighed alike."""
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed + 1)
        share = len(y) / len(self.languages) / np.maximum(np.bincount(y, minlength=len(self.languages)), 1)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), cfg.batch):
                at = order[i : i + cfg.batch]
                xb, yb = x[at], y[at]
                z, places = self.pooled(xb)
                h = np.maximum(z, 0)
                s = h @ self.out + self.out_bias
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                s[np.arange(len(yb)), yb] -= 1
                s *= (share[yb] / len(yb))[:, None].astype(np.float32)
                dz = (s @ self.out.T) * (z > 0)
                grads = []
                for k, table_ in enumerate(self.tables):
                    part = dz[:, k * cfg.filters : (k + 1) * cfg.filters]
                    g = np.zeros_like(table_)
                    for o in range(len(table_)):
                        byte = np.take_along_axis(xb, places[k] + o, axis=1)
                        np.add.at(g[o], (byte, np.arange(cfg.filters)[None, :]), part)
                    grads.append(g)
                grads += [dz.sum(axis=0), h.T @ s, s.sum(axis=0)]
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def train_language(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> ByteConvNet:
    """Fit on (text, lang) of rows with a language and an id whose remainder mod 3 is not 1.

    The sample is chosen on ids and languages alone, at most cfg.docs_per_language of each, and broadcast; the windows
    of it, at most cfg.windows_per_doc of a document, spread over the whole text, come to the driver. Rows that repeat
    count once; null texts teach nothing.
    """
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and doc_id is not null").where(remainder("doc_id", 3) != 1)
    # A threshold of the hash that about twice as many ids pass, from the counts, so that no task ranks a whole language.
    # One row a language, and the network has a column for each.
    counts = known.groupBy("lang").agg((F.lit(2.0 * cfg.docs_per_language + 64) / F.count("*")).alias("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = (
        known.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .select("doc_id", "lang").distinct().withColumn("_r", rank).where(f"_r <= {cfg.docs_per_language}").select("doc_id", "lang")
    )
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(2)), strict=True):
                w = windows(text, cfg.window)
                if len(w) > cfg.windows_per_doc:  # spread over the whole text
                    draw = np.random.default_rng(zlib.crc32(str(key).encode()))
                    w = w[np.sort(draw.choice(len(w), cfg.windows_per_doc, replace=False))]
                found.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["lang", "x"])

    got = sample.mapInArrow(run, "lang string, x binary").toArrow().to_pydict()
    pairs = sorted({(lang, x) for lang, x in zip(got["lang"], got["x"], strict=True) if x})
    languages = sorted({lang for lang, _ in pairs})
    net = ByteConvNet(languages, cfg)
    if pairs:
        x = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(-1, cfg.window) for _, b in pairs])
        y = np.concatenate([np.full(len(b) // cfg.window, languages.index(lang)) for lang, b in pairs])
        net.train(x, y)
    return net


def predict_language(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """(doc_id, lang_pred, score), from all windows of the whole text and nothing else.

    The log-probabilities of the windows are averaged (weighed by their bytes), the largest language wins, score is
    its share. Null texts, texts without a letter, and all texts if nothing was learned: `und`, score 0. Very long texts
    are read window by window; repeated rows repeat; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        size, known = net.cfg.window, len(net.languages)
        for batch in batches:
            raw, texts = batch.column(1).to_pylist(), bytes_of(batch.column(1))
            langs, scores = ["und"] * len(raw), [0.0] * len(raw)
            letters = [t is not None and known > 0 and any(map(str.isalpha, t)) for t in raw]
            for a, b in groups_of_texts(texts, 1 << 19):
                at = [i for i in range(a, b) if letters[i]]
                if not at:
                    continue
                parts = [windows(texts[i], size) for i in at]
                count = np.array([len(w) for w in parts])
                p = net.log_probabilities(np.concatenate(parts))
                weight = np.full(len(p), float(size))
                last = np.cumsum(count) - 1
                weight[last] = [len(texts[i]) - (n - 1) * size for i, n in zip(at, count, strict=True)]
                total = np.add.reduceat(p * weight[:, None], last + 1 - count, axis=0) / np.add.reduceat(weight, last + 1 - count)[:, None]
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                for i, s in zip(at, share, strict=True):
                    langs[i], scores[i] = net.languages[int(s.argmax())], float(s.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
