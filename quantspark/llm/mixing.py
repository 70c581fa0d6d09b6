"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import cut, drop, fresh, release

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources by code point of their name, null last; repeated when there are more sources.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: No source, and no document, gives more than this many times its size.
    max_repeats: int = 3
    #: Slices of the sampling order in each unit of the logarithm of the rank. Each source's order is summed slice by
    #: slice, so that a source with a third of all rows is dealt over all tasks.
    slices: int = 256


def word_count(text) -> F.Column:
    """Number of white-space separated words; 0 for null. Counted as starts of words, without making an array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size) -> + target: weights filled up to ``max_repeats`` times each source.

    Below the common level every source gets level x weight; the sources whose cap lies lower get their cap. Ordering
    sources by cap/weight, the level is found in one pass: the first source that the level of the sources from it on
    does not reach ends the capped ones. One row a source, so the global window is small.
    """
    weights = F.array(*[F.lit(w) for w in cfg.weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("_r", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(weights, (F.col("_r") - 1) % len(cfg.weights) + 1)
    )
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    every = Window.partitionBy()
    ranked = (
        named.withColumn("_cap", cfg.max_repeats * F.col("source_size"))
        .withColumn("_before", F.sum("_cap").over(fill) - F.col("_cap"))
        .withColumn("_open", F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_open"))
        .withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    )
    level = F.max(F.when(F.col("_free"), F.struct(-F.col("_cap") / F.col("_w"), -F.col("_r"), F.col("_level")))).over(every)
    return ranked.withColumn("_l", level["_level"]).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("_l") * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
        .alias("target"),
    )


def unit_draw(key) -> F.Column:
    """A number in (0, 1) fixed by the key, alike in every run and engine (the first 13 hex digits of its MD5)."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _draw(doc_id) -> F.Column:
    return unit_draw(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _odds(u, size, scale) -> F.Column:
    """Pareto rank of a document: random odds over the odds of its inclusion, scale * size. None with no chance of it."""
    pi = scale * size
    return F.when((pi > 0) & (pi < 1), (u / (1 - u)) / (pi / (1 - pi)))


def inclusion_scales(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """+ scale, certain: documents are included with probability scale * size, those that reach 1 for certain, such that
    the expected words are the target left; certain: the words of the latter.

    sizes: source, size, n (documents of that size); plan: one row a source of ``sizes`` with the words left. The largest
    size whose probability, if all larger ones are certain, is at most 1 gives the scale. One row a source.
    """
    every = Window.partitionBy("source")
    down = every.orderBy(F.desc("size"))
    words = F.sum(F.col("size") * F.col("n")).over(down) - F.col("size") * F.col("n")
    squares = F.sum((F.col("size") * F.col("size") * F.col("n")).cast("double")).over(down.rowsBetween(0, Window.unboundedFollowing))
    by = plan.withColumnRenamed("source", "of")
    # Windows and sums by source alone, so that one exchange serves them all.
    tried = sizes.join(by, F.col("source").eqNullSafe(F.col("of"))).withColumn("larger", words).withColumn("squares", squares)
    tried = tried.withColumn("scale", F.when(F.col("size") > 0, (F.col("left") - F.col("larger")) / F.col("squares")))
    open_ = F.max(F.when(F.col("scale") * F.col("size") <= 1, F.struct("size", "scale"))).over(every)
    sure = tried.withColumn("scale", F.greatest(open_["scale"], F.lit(0.0)))
    return sure.groupBy("source").agg(
        *[F.first(c).alias(c) for c in plan.columns if c != "source"], F.first("scale").alias("scale"),
        F.sum(F.when(F.col("scale") * F.col("size") >= 1, F.col("size") * F.col("n")).otherwise(0)).alias("certain"),
    )


def _planned(docs: DataFrame, cfg: MixConfig) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes with the plan of their source and their Pareto rank (null where it doesn't decide), and the
    plan, one row a source."""
    # Several readers follow; the sizes are kept, so that the texts are read once.
    base = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sizes = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cfg)
    whole = F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(inclusion_scales(sizes, plan))
    by = plan.withColumnRenamed("source", "of")
    drawn = base.join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("u", _draw("doc_id"))
    return drawn.withColumn("rank", _odds(F.col("u"), F.col("size"), F.col("scale"))).drop("u"), plan


def _in_order(drawn: DataFrame, cfg: MixConfig) -> DataFrame:
    """The documents that have a rank, with more: 1 if the sample takes them."""
    # Slices of the logarithm of the rank, so that a source is summed slice by slice over all tasks.
    ranked = drawn.where("rank is not null").withColumn("slice", F.floor(F.ln("rank") * cfg.slices))
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice")
    begun = slices.select(F.col("source").alias("of"), F.col("slice").alias("s"), (F.sum("words").over(upto) - F.col("words")).alias("begin"))
    order = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.join(begun, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("s")))
    last = F.col("begin") + F.sum("size").over(order) - F.col("size") / 2
    return ranked.withColumn("more", (last <= F.col("left") - F.col("certain")).cast("int")).drop("of", "s", "begin", "slice")


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """How many words of every document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    Every document first gets the certain copies, floor(target / source size). The rest of the target is drawn as one
    more copy by Pareto order sampling with inclusion probabilities in proportion to size: documents whose probability
    reaches 1 are taken; the others are ranked by the odds of a fixed random number over the odds of their inclusion,
    and taken in that order while the middle of the document still lies within what is left. The sample thus has a
    fixed size in words, to half a document.

    Null text counts 0 words and takes none; null sources form one source, last in order; a null doc_id draws as the
    empty string; repeated rows draw alike and are ranked next to each other; an empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    drawn, _ = _planned(docs, cfg)
    sure = drawn.where("rank is null").withColumn("more", ((F.col("scale") > 0) & (F.col("scale") * F.col("size") >= 1)).cast("int"))
    copies = F.least(F.col("whole") + F.col("more"), F.lit(cfg.max_repeats)).cast("int")
    mixed = _in_order(drawn, cfg).unionByName(sure).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix_rows(docs: DataFrame, cfg: MixConfig = MixConfig(), broadcast_sources: int = 20_000) -> DataFrame:
    """``docs`` with copies (int), as mix_sources() takes them.

    What a source's order takes is a prefix of it, so one row a source (its plan and the last document of the prefix)
    decides for whole rows without moving them. Rows that tie with the last one count as taken. The table of sources
    is broadcast only up to ``broadcast_sources`` rows. A column ``copies`` of the documents is replaced.
    """
    docs = docs.drop("copies")
    drawn, plan = _planned(docs, cfg)
    of, edge, whole, scale = fresh(docs, "of", "edge", "whole", "scale")
    # Only documents with a rank can end a prefix; the certain ones are known by their size.
    last = _in_order(drawn, cfg).where("more = 1").groupBy(F.col("source").alias("s")).agg(F.max(F.struct("rank", "doc_id", "size")).alias("last"))
    edges = plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    edges = cut(edges.select(F.col("source").alias(of), F.col("last").alias(edge), F.col("whole").alias(whole), F.col("scale").alias(scale)))
    drop(plan)
    release(docs.sparkSession)
    few = F.broadcast(edges) if edges.count() <= broadcast_sources else edges
    # Bound to lambda variables, so that a text is counted once, however often its size is used and filters are pushed.
    sized = F.array(F.struct(word_count(F.col("text")).alias("size"), _draw("doc_id").alias("u")))
    ranked = F.transform(sized, lambda x: F.struct(_odds(x["u"], x["size"], F.col(scale)).alias("rank"), F.col("doc_id"), x["size"].alias("size")))

    def copies(x: F.Column) -> F.Column:
        sure = (F.col(scale) > 0) & (F.col(scale) * x["size"] >= 1)
        taken = F.when(x["rank"].isNull(), sure).otherwise(F.coalesce(x <= F.col(edge), F.lit(False))).cast("int")
        return F.least(F.col(whole) + taken, F.lit(cfg.max_repeats)).cast("int")

    joined = docs.join(few, F.col("source").eqNullSafe(F.col(of)))
    return joined.withColumn("copies", F.element_at(F.transform(ranked, copies), 1)).drop(of, edge, whole, scale)
