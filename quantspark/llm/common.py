"""Shared pieces of the training-data operators: word hashing, checkpoints, components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in an Arrow batch of whole texts: some documents are very long, and a batch is held in memory.
BATCH_ROWS = 512
#: Bytes hashed at a time; segments are cut at separators, so words never straddle two of them.
SEGMENT = 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of text tables. A session setting, read when a Python operator is planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Written tables that haven't been dropped, by the identity of their DataFrame.
_MADE: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session, whose executors are the driver's own process, may go without; it gets a folder of its own.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the shared folder, so they survive lost executors and aren't made again.

    drop() deletes the table when its last reader has run; what is left goes when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quantspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    if not _MADE:
        atexit.register(clear)
    _MADE[id(made)] = made, path
    return made


def _delete(made: DataFrame, path: str) -> None:
    spark = made.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote, which nothing reads any more; others are left alone."""
    for t in tables:
        if t is not None and id(t) in _MADE:
            _delete(*_MADE.pop(id(t)))


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner deletes the shuffle files of finished jobs now."""
    gc.collect()
    spark._jvm.System.gc()


def clear() -> None:
    """Delete every table of cut() that is left; their DataFrames can't be read afterwards."""
    while _MADE:
        try:
            _delete(*_MADE.popitem()[1])
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have, whatever columns a user has added."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieve(df: DataFrame, key, keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the values of the one column of ``keys``: all that are, and few others.

    A bitmap of 64 * ``words`` hashed bits is broadcast, never more than ``words`` rows, however many keys there are;
    with more keys than bits it only lets more rows pass. What follows must join with the keys themselves.
    """
    def place(col) -> tuple[F.Column, F.Column]:
        h = F.pmod(F.xxhash64(col), F.lit(64 * words))
        return F.floor(h / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))

    word, bit = place(F.col(keys.columns[0]))
    bits = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    w, b = fresh(df, "w", "b")
    word, bit = place(key)
    held = df.join(F.broadcast(bits.toDF(w, b)), word == F.col(w))
    return held.where(F.col(b).bitwiseAND(bit) != 0).drop(w, b)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


# --- word hashing -------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur3 constants), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _space_table() -> np.ndarray:
    word = np.ones(256, dtype=bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _alnum_table() -> np.ndarray:
    word = np.zeros(256, dtype=bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word


#: Word bytes: all but ASCII white space; and ASCII letters, digits and every byte of a non-ASCII character.
SPACE_WORDS, ALNUM_WORDS = _space_table(), _alnum_table()


class WordHasher:
    """Position-free 64-bit hashes of all words of a byte buffer, A-Z folded, without a Python loop over words.

    A word's hash is a polynomial in a fixed odd base over random byte values, read off prefix sums, so the cost
    is a few vector operations a byte. Equal words have equal hashes wherever they stand.
    """

    def __init__(self, word: np.ndarray, seed: int = 7) -> None:
        self.word = word
        self.value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.value[65:91] = self.value[97:123]
        self.base = np.uint64(6364136223846793005)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, step in (("power", self.base), ("back", self.inverse)):
                steps = np.full(n, step, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def _segment(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._grow(len(buf) + 1)
        inside = np.zeros(len(buf) + 2, dtype=bool)
        self.word.take(buf, out=inside[1:-1], mode="clip")
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        value = self.value.take(buf, mode="clip")
        value *= self.power[: len(buf)]
        np.cumsum(value, out=total[1:])
        return start, end, mix((total[end] - total[start]) * self.back[start])

    def __call__(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word of ``buf`` (uint8)."""
        if len(buf) <= SEGMENT:
            return self._segment(buf)
        parts, at = [], 0
        while at < len(buf):
            to = min(at + SEGMENT, len(buf))
            while to < len(buf) and self.word[buf[to]]:
                gap = np.flatnonzero(~self.word[buf[to : to + SEGMENT]])
                to = to + int(gap[0]) if len(gap) else min(to + SEGMENT, len(buf))
            s, e, h = self._segment(buf[at:to])
            parts.append((s + at, e + at, h))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def groups_of_texts(texts: list[bytes], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a blank, and the offset of each text."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), at


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of consecutive words of the same text, and the text of each.

    A text of fewer than k words, but at least one, gives its whole sequence as one shingle.
    """
    n = len(hashes)
    count = np.bincount(doc, minlength=int(doc[-1]) + 1 if n else 0)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if n else np.zeros(0, dtype=np.int64)
    out = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        out = mix(out * _ODD + hashes[j : n - k + 1 + j]) if n >= k else out
    whole = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, dtype=bool)
    out, where = out[whole], doc[: n - k + 1][whole] if n >= k else doc[:0]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for d in short:
            h = np.array([count[d]], dtype=np.uint64)
            for i in range(first[d], first[d] + count[d]):
                h = mix(h * _ODD + hashes[i : i + 1])
            extra.append(h)
        out, where = np.concatenate((out, *extra)), np.concatenate((where, short))
    return out, where


def bytes_of(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null as empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


# --- connected components -----------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of ``n`` vertices: at most n - 1 of them."""
    up = list(range(n))
    out = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for the end points of ``edges(a, b)``: the smallest id reachable.

    Contraction: every vertex takes the least of itself and its neighbours, edges are rewritten to what their ends
    took, loops and repeats drop out, until no edge is left. The number of vertices with edges at least halves each
    round; every round ends in written tables, and nothing leaves the executors. Ids must not be null.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        if labels is None:
            new = least.select("id", F.col("to").alias("component"))
        else:
            step = least.select(F.col("id").alias("component"), "to")
            new = labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        new = cut(new)
        first = least.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        second = least.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        rest = left.join(first, "a").join(second, "b").where("ta <> tb")
        rest = cut(rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        drop(left, least, labels)
        left, labels = rest, new
        if left.isEmpty():
            drop(left)
            return labels
