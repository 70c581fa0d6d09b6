"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, components."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import (
    SPACE_WORDS,
    WordHasher,
    bytes_of,
    connected_components,
    cut,
    drop,
    forest,
    fresh,
    groups_of_texts,
    joined,
    mix,
    release,
    shingles,
    sieve,
    small_batches,
)


@dataclass(frozen=True)
class NearDupConfig:
    #: Words in a shingle; least Jaccard similarity in percent.
    words: int = 5
    percent: int = 80
    #: Bands of rows of the signature. At 80 % a pair shares no band with probability (1 - 0.8^6)^32 < 7e-5, and
    #: unlike texts that share common shingles seldom do.
    bands: int = 32
    rows: int = 6
    #: Star rounds before the pairs between still separate parts of a bucket are compared one by one.
    stars: int = 2  # at least 2
    #: Buckets of up to so many members are compared pair by pair, larger ones in tiles of so many rows a side; and
    #: comparisons that share one copy of a hub's text.
    few: int = 32
    tile: int = 256
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows


def super_minhash(element: np.ndarray, doc: np.ndarray, n_docs: int, m: int, seed: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of many sets at once: (n_docs, m) float64.

    Every element deals the ranks 0..m-1 to the m components by its own random permutation (a Fisher-Yates shuffle
    drawn step by step) and adds a uniform fraction, so ranks are correlated: none is dealt twice. Steps are taken
    for all elements together; once every component of a set holds a value below the step, later ranks can't lower it
    and the set stops. Large sets stop after a step or two, and only small ones go on.
    """
    out = np.full((n_docs, m), np.inf)
    flat, live = out.reshape(-1), np.arange(len(element))
    perm = None
    for j in range(m):
        if not len(live):
            break
        draw = mix(element[live] + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        k = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        fraction = (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0
        if perm is None:
            at = k
        else:
            row = np.arange(len(live))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(flat, doc[live] * m + at, j + fraction)
        full = out.max(axis=1) < j + 1
        stay = ~full[doc[live]]
        if perm is None:
            live, k = live[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(live), 1))
            perm[np.arange(len(live)), k] = 0
        else:
            live, perm = live[stay], perm[stay]
    return out


def shingle_sets(texts: list[bytes], k: int, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text: (hash, text)."""
    buf, at = joined(texts)
    start, _, h = hasher(buf)
    doc = np.searchsorted(at, start, side="right") - 1
    s, where = shingles(h, doc, k)
    order = np.lexsort((s, where))
    s, where = s[order], where[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (where[1:] != where[:-1])
    return s[new], where[new]


def _signed(cfg: NearDupConfig):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACE_WORDS)
        for batch in batches:
            texts = bytes_of(batch.column(1))
            n, cls, bands = [np.zeros(0, np.int64)], [], [np.zeros((0, cfg.bands), np.uint64)]
            for a, b in groups_of_texts(texts):
                s, where = shingle_sets(texts[a:b], cfg.words, hasher)
                size = np.bincount(where, minlength=b - a)
                # A set's class: two sums of differently mixed hashes, 128 bits alike in any order of elements.
                total = np.zeros((b - a, 2), dtype=np.uint64)
                for i, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
                    np.add.at(total[:, i], where, mix(s ^ np.uint64(salt)))
                n.append(size)
                cls += [x.tobytes() for x in total]
                sig = super_minhash(s, where, b - a, cfg.size, cfg.seed)
                word = sig.view(np.uint64).reshape(b - a, cfg.bands, cfg.rows)
                band = np.zeros((b - a, cfg.bands), dtype=np.uint64) + np.arange(cfg.bands, dtype=np.uint64)
                for r in range(cfg.rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + word[:, :, r])
                bands.append(band)
            flat = np.concatenate(bands).view(np.int64)
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * cfg.bands
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(n).astype(np.int64)), pa.array(cls, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))],
                names=["doc_id", "rk", "n", "cls", "bands"],
            )

    return run


def _verified(cfg: NearDupConfig):
    """Of rows (hub, other, text, ca, cb), sorted such that a hub's own row (other null) comes before its others: the
    (ca, cb) of the others whose full set is similar enough to the hub's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hub, held = WordHasher(SPACE_WORDS), None, np.zeros(0, np.uint64)
        for batch in batches:
            a, other, texts = batch.column(0).to_pylist(), batch.column(1), bytes_of(batch.column(2))
            good = np.zeros(len(a), dtype=bool)
            sets: list[np.ndarray] = []
            for i, j in groups_of_texts(texts):
                s, where = shingle_sets(texts[i:j], cfg.words, hasher)
                sets += np.split(s, np.searchsorted(where, np.arange(1, j - i)))
            for i, own in enumerate(other.is_null().to_pylist()):
                if own:
                    hub, held = a[i], sets[i]
                    continue
                y = sets[i]
                if a[i] != hub or not len(held) or not len(y) or 100 * min(len(held), len(y)) < cfg.percent * max(len(held), len(y)):
                    continue
                both = len(held) + len(y) - len(np.union1d(held, y))
                good[i] = 100 * both >= cfg.percent * (len(held) + len(y) - both)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(3).take(keep), batch.column(4).take(keep)], names=["a", "b"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b) component links of the pairs(a, b, ca, cb) that are similar enough, on the full sets of both.

    A pair carries the text of b; the text of a hub a travels once for each ``tile`` of its pairs, so a hub with a third
    of all rows is dealt over many tasks. Texts, not sets of hashes: they compress to less than half of these.
    """
    tiles = pairs.groupBy("a").agg(F.ceil(F.count("*") / cfg.tile).cast("int").alias("tiles"))
    own = tiles.join(texts, tiles["a"] == texts["node"]).select(
        "a", F.lit(None).cast("long").alias("b"), "text", F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("r"),
    )
    many = tiles.where("tiles > 1").withColumnRenamed("a", "hub")
    asked = pairs.join(many, pairs["a"] == many["hub"], "left").withColumn("r", F.pmod(F.xxhash64("b"), F.coalesce("tiles", F.lit(1))).cast("int"))
    asked = asked.join(texts, asked["b"] == texts["node"]).select("a", "b", "text", "ca", "cb", "r")
    rows = own.union(asked).repartition("a", "r").sortWithinPartitions("a", "r", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text", "ca", "cb").mapInArrow(_verified(cfg), "a long, b long")


def _sets(cfg: NearDupConfig):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACE_WORDS)
        for batch in batches:
            texts, out = bytes_of(batch.column(1)), []
            for a, b in groups_of_texts(texts):
                s, where = shingle_sets(texts[a:b], cfg.words, hasher)
                out += [x.tobytes() for x in np.split(s, np.searchsorted(where, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "elements"])

    return run


def tile_links(sets: list[np.ndarray], ask: np.ndarray, percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Spanning links between the asking sets and the others whose exact similarity reaches the threshold.

    Intersections are counted for all of a tile at once, as products of incidence matrices over the elements that
    several sets hold, some thousand elements at a time.
    """
    element, back = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    common = np.bincount(back, minlength=len(element)) > 1
    place = np.cumsum(common) - 1
    keep = common[back]
    row, col = row[keep], place[back[keep]]
    q, o = np.flatnonzero(ask), np.flatnonzero(~ask)
    both = np.zeros((len(q), len(o)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(common.sum()), columns):
        lo, hi = np.searchsorted(col, (at, at + columns))
        m = np.zeros((len(sets), columns), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        both += m[q] @ m[o].T
    union = size[q][:, None] + size[o][None, :] - both
    i, j = np.nonzero(100 * both >= percent * union)
    return forest(len(sets), q[i], o[j])


def _links_in_tiles(left: DataFrame, texts: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b) links between components, from large buckets: members outside the main one against all, in tiles.

    No pair leaves a tile, only links that span what it connects. left: bucket, node, component, main.
    """
    sets = cut(texts.join(left.select("node").distinct(), "node", "left_semi").mapInArrow(_sets(cfg), "node long, elements binary"))
    counts = left.groupBy("bucket").agg(
        F.ceil(F.count_if(F.expr("component <> main")) / cfg.tile).cast("int").alias("rows"), F.ceil(F.count("*") / cfg.tile).cast("int").alias("cols")
    ).where("rows > 0")
    sides = left.join(counts.hint("merge"), "bucket")  # a join that adaptive execution can split, as one bucket may hold most
    row, col = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")).cast("int")
    tiles = (
        sides.where("component <> main").select("bucket", "node", "component", row.alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(True).alias("ask"))
        .unionByName(sides.select("bucket", "node", "component", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), col.alias("c"), F.lit(False).alias("ask")))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, ask = pdf["component"].to_numpy(), pdf["ask"].to_numpy()
        span = tile_links([np.frombuffer(x, dtype=np.uint64) for x in pdf["elements"]], ask, cfg.percent) if ask.any() and not ask.all() else []
        return pd.DataFrame({"a": [int(part[x]) for x, _ in span], "b": [int(part[y]) for _, y in span]}, dtype="int64")

    return tiles.join(sets, "node").groupBy("bucket", "r", "c").applyInPandas(run, "a long, b long").where("a <> b")


def _row_key(docs: DataFrame) -> F.Column:
    """128 bits that name a row by its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("\x00"), F.coalesce(docs["text"], F.lit("")))))


def _met(classes: DataFrame) -> DataFrame:
    """(bucket, node, n, degree): the places of nodes in the buckets that several nodes share. Most buckets hold one
    node: they are counted first, and what a sieve of the shared ones keeps is all that is joined."""
    dealt = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = cut(dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    met = cut(sieve(dealt, F.col("bucket"), shared.select("bucket")).join(shared.hint("merge"), "bucket"))
    drop(shared)
    # How often a node meets others: the original of a group of copies meets most and makes the best hub.
    degree = met.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = cut(met.select("bucket", "node", "n").join(degree, "node"))
    drop(met)
    release(classes.sparkSession)
    return members


def _grouped(docs: DataFrame, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, n, cls) of every row, and (cls, first, keep): smallest doc_id of the class's component and the key
    of the row that has it."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _row_key(docs).alias("rk"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(base.mapInArrow(_signed(cfg), f"doc_id {id_type}, rk binary, n long, cls binary, bands array<long>"))
    # Nodes are classes, numbered as they are written; their least row stands for them.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("m")
    classes = cut(
        signed.where("n > 0").groupBy("cls").agg(least, F.first("bands").alias("bands"), F.first("n").alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "cls", F.col("m.rk").alias("rk"), F.col("m.doc_id").alias("least"), "n", "bands")
    )
    release(spark)
    members = _met(classes)
    nodes = cut(members.select("node").distinct())
    keys = cut(classes.select("node", "rk").join(nodes, "node"))
    texts = sieve(base.select("rk", "text"), F.col("rk"), keys.select("rk")).join(keys.hint("merge"), "rk")
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]))
    drop(keys)

    labels = cut(nodes.withColumn("component", F.col("node")))
    drop(nodes)
    tested: list[DataFrame] = []
    for step in range(cfg.stars + 1):
        placed = members.join(labels, "node") if step else members.withColumn("component", F.col("node"))
        # The first hub is the member that meets most; later ones the same in the part the first isn't in.
        by = F.struct("degree", "node", "component", "n")
        hubs = placed.groupBy("bucket").agg(
            F.max(by).alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")
        ).where("lo <> hi").select("bucket", F.col("h.node").alias("a"), F.col("h.component").alias("ca"), F.col("h.n").alias("na"), "size")
        links, left = None, None
        if step == 1:
            rest = placed.join(hubs.select("bucket", F.col("ca").alias("c1")), "bucket").where("component <> c1")
            hubs = rest.groupBy("bucket").agg(F.max(by).alias("h")).select("bucket", F.col("h.node").alias("a"), F.col("h.component").alias("ca"), F.col("h.n").alias("na"))
        if step < cfg.stars:
            met = placed.join(hubs, "bucket")
        else:
            # What isn't in the hub's component by now is compared with all of the bucket.
            left = cut(placed.join(hubs.select("bucket", F.col("ca").alias("main"), "size"), "bucket"))
            few, many = left.where(F.col("size") <= cfg.few), left.where(F.col("size") > cfg.few)
            ask = few.where("component <> main").select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
            met = few.join(ask, "bucket")
            links = _links_in_tiles(many, texts, cfg)
        pairs = (
            met.select("a", F.col("node").alias("b"), "ca", F.col("component").alias("cb"), "na", F.col("n").alias("nb"))
            .where(f"ca <> cb and 100 * least(na, nb) >= {cfg.percent} * greatest(na, nb)")
            .select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b", "ca", "cb").dropDuplicates(["x", "y"])
        )
        for done in tested:
            pairs = pairs.join(done.select("x", "y"), ["x", "y"], "left_anti")
        pairs = cut(pairs)
        tested.append(pairs)
        found = _compared(pairs, texts, cfg)
        # Links join the components of the rounds before, so each round contracts only what is new.
        joined_ = connected_components(found if links is None else found.union(links))
        to = joined_.select(F.col("id").alias("component"), F.col("component").alias("to"))
        new = cut(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        drop(labels, joined_, left)
        labels = new
        release(spark)
    drop(members, texts, *tested)
    named = classes.select("cls", "node", "least", "rk").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("least").isNull(), "least", "rk")
    smallest = named.groupBy("component").agg(F.min(order).alias("m"))
    final = cut(named.join(smallest, "component").select("cls", F.col("m.least").alias("first"), F.col("m.rk").alias("keep")))
    drop(classes, labels)
    release(spark)
    rows = signed.select("doc_id", "rk", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    return rows, final


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked when the Jaccard similarity of their sets of distinct k-word shingles reaches the threshold
    (words: white-space separated, A-Z folded; fewer words than k: the whole sequence as one shingle). component_id is
    the smallest doc_id reachable by links.

    1. One pass of Arrow batches gives size, class (equal sets, equal class) and band hashes of every document.
    2. Equal sets collapse to one class each, so copies cost nothing further.
    3. Classes meet in band buckets. Instead of all pairs of a bucket, every member is compared with one hub of its
       bucket, then with another. A last round compares what is still outside the hub's component with all of its
       bucket, in tiles where the bucket is large. No pair that shares a band is thus lost to the stars, and a group of
       n near copies takes about n comparisons a band.
    4. A comparison is exact, on the full sets.

    Null and wordless texts have an empty set, n_shingles 0, and are linked with nothing; repeated rows are equal
    sets; a null doc_id counts in no minimum (a document linked with nothing keeps it); an empty table gives no rows;
    other columns are not read.
    """
    rows, final = _grouped(docs, cfg)
    return rows.join(final, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("first", "doc_id") == F.col("doc_id"), F.col("first").isNull()).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` without near copies: of each group of near_duplicates() the row with the smallest doc_id stays.

    Rows without words are linked with nothing and stay. Repeated rows (equal doc_id and text) stay once.
    """
    rows, final = _grouped(docs, cfg)
    (rk,) = fresh(docs, "rk")
    stay = rows.where("n = 0").select(F.col("rk").alias(rk)).union(final.select("keep")).distinct()
    return docs.withColumn(rk, _row_key(docs)).join(stay, rk, "left_semi").dropDuplicates([rk]).drop(rk)
