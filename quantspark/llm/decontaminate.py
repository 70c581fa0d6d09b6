"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import ascii_lower, cut, fresh

#: Words for comparison: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z folded; so marks,
#: quotes and line breaks around a passage don't hide it.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ContainmentConfig:
    #: Words in a shingle, and the least share of an item's shingles that the document must hold.
    words: int = 5
    threshold: float = 0.8
    #: Upper bounds of the size partitions of items grow by this factor.
    growth: float = 1.25
    #: Sketches are broadcast only up to so many rows (24 bytes each, so a few MB); beyond, the joins shuffle.
    broadcast_rows: int = 200_000


def words_of(text) -> F.Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), lambda w: w != "")


def _windows(k, made: str = "concat_ws(' ', {})") -> F.Column:
    """Array of the k-word shingles of _w, each ``made`` of a slice of words; none if there are fewer words."""
    one = made.format(f"slice(_w, i, {k})")
    return F.expr(f"if(size(_w) < {k}, array(), transform(sequence(1, greatest(size(_w) - {k} + 1, 1)), i -> {one}))")


#: Hash of a shingle's words, without making the shingle's text.
HASHED = "xxhash64({})"


def item_shingles(items: DataFrame, cfg: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """(item_id, k, q, shingle): the distinct shingles of every item. An item with fewer than ``cfg.words`` words is
    one shingle of k = its words; one without words has none."""
    return (
        items.select("item_id", words_of(F.col("text")).alias("_w"))
        .withColumn("k", F.least(F.lit(cfg.words), F.size("_w")))
        .where("k > 0")
        .withColumn("_s", F.array_distinct(_windows("k")))
        .select("item_id", "k", F.size("_s").alias("q"), F.explode("_s").alias("shingle"))
        .distinct()
    )


def item_sketches(shingles: DataFrame, cfg: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """(item_id, k, h): bottom-s MinHash values of every item.

    Items are partitioned by size, and all of a partition (whose largest size is u) keep s = u - ceil(t u) + 1 values:
    more than a document that holds t of an item's shingles can lack, so one of them is in that document (recall 1).
    """
    upper = F.ceil(F.pow(F.lit(cfg.growth), F.ceil(F.log(F.col("q").cast("double")) / F.log(F.lit(cfg.growth)) - 1e-9)))
    rank = F.row_number().over(Window.partitionBy("item_id", "k").orderBy("h", "shingle"))
    return (
        shingles.withColumn("h", F.xxhash64(F.split("shingle", " ")))
        .withColumn("u", upper)
        .withColumn("s", F.col("u") - F.ceil(F.col("u") * cfg.threshold - 1e-9) + 1)
        .where("q > 0")
        .withColumn("_r", rank)
        .where("_r <= s")
        .select("item_id", "k", "h")
    )


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", cfg: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """(key, item_id, n_shared, n_item, containment) for every item of which the document holds ``cfg.threshold``.

    Documents are probed with all their shingles against the sketches (a document sketch of fixed size loses short
    items in long documents, and one of a size that does not is all of them), which leaves few candidates; these are
    counted exactly on the shingles themselves. Shingles are counted once in an item and once in a document.

    Null or wordless texts hold and are nothing, nor is an item without an id; rows with one ``key`` count as one document; repeated items (one
    item_id) are one item with the shingles of all; empty tables give no rows; other columns are not read.
    """
    shingles = item_shingles(items, cfg).select("item_id", "k", "shingle").distinct()
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("q"))
    shingles = cut(shingles.join(sizes, "item_id"))
    # At most cfg.words numbers come to the driver: the lengths of shingles that items have.
    lengths = sorted(r["k"] for r in shingles.select("k").distinct().collect())
    words = docs.select(F.col(key).alias("_key"), words_of(F.col("text")).alias("_w"))

    def stream(of: DataFrame, made: str, name: str) -> DataFrame:
        parts = [of.select("_key", F.lit(k).alias("k"), F.explode(_windows(k, made)).alias(name)) for k in lengths]
        return reduce(DataFrame.unionByName, parts)

    if not lengths:
        empty = shingles.join(docs.select(F.col(key)), F.lit(False)).where("false")
        return empty.select(key, "item_id", F.col("q").alias("n_shared"), F.col("q").alias("n_item"), F.lit(0.0).alias("containment"))
    sketches = item_sketches(shingles, cfg)
    hits = stream(words, HASHED, "h").join(_small(sketches, cfg), ["k", "h"])
    candidates = cut(hits.select("_key", "item_id").distinct())
    named = candidates.select(F.col("_key").alias("_c")).distinct()
    held = docs.select(key, "text").join(_small(named, cfg), F.col(key).eqNullSafe(F.col("_c")), "left_semi")
    found = stream(held.select(F.col(key).alias("_key"), words_of(F.col("text")).alias("_w")), "concat_ws(' ', {})", "shingle")
    counted = (
        found.join(_small(shingles, cfg), ["k", "shingle"])
        .select("_key", "item_id", "q", "shingle").distinct()
        .groupBy("_key", "item_id", "q").agg(F.count("*").alias("n_shared"))
    )
    pair = candidates.select(F.col("_key").alias("_c"), F.col("item_id").alias("_ci"))
    return (
        counted.join(pair, F.col("_key").eqNullSafe(F.col("_c")) & (F.col("item_id") == F.col("_ci")), "left_semi")
        .where(F.col("n_shared") >= F.col("q") * cfg.threshold - 1e-9)
        .select(
            F.col("_key").alias(key), "item_id", "n_shared", F.col("q").alias("n_item"),
            (F.col("n_shared") / F.col("q")).alias("containment"),
        )
    )


def _small(df: DataFrame, cfg: ContainmentConfig) -> DataFrame:
    """Broadcast after counting, or left to a shuffle join."""
    return F.broadcast(df) if df.count() <= cfg.broadcast_rows else df


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", cfg: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see contained_items(). Rows that share a
    ``key`` with one that holds an item go with it."""
    (name,) = fresh(docs, "found")
    found = cut(contained_items(docs, items, key, cfg).select(F.col(key).alias(name)).distinct())
    return docs.join(_small(found, cfg), F.col(key).eqNullSafe(F.col(name)), "left_anti")
