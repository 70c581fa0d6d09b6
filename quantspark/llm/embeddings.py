"""Embedding near-dedup: collision counting on sorted one-dimensional projections, exact verification, components."""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import connected_components, cut, drop, forest, mix


#: Rows whose cells are found at a time.
BATCH = 4096


@dataclass(frozen=True)
class EmbeddingConfig:
    #: Least cosine of a link.
    cosine: float = 0.98
    #: Projections on which collisions are counted; half width of a query's window, in standard deviations that the
    #: difference of two vectors at the least cosine has on a random direction.
    projections: int = 24
    window: float = 2.5
    #: Greatest expected share of true links that the needed count may lose, and that no cell of any table holds.
    miss: float = 1e-6
    #: Width of a cell on a dealing projection, in the same unit; what carrying a vector to a cell costs, in comparisons
    #: of two; and projections of a table, where not chosen by the least cost.
    cell: float = 12.0
    copy: int = 1024
    dims: int | None = None
    #: Rows of a tile's side; cells of up to ``small`` rows share a task; cells of more than ``hot`` rows are hot.
    tile: int = 1024
    small: int = 64
    hot: int = 4096
    seed: int = 23


def needed_count(cfg: EmbeddingConfig) -> int:
    """Largest count that a pair at the least cosine reaches but for a probability of ``cfg.miss``.

    On a random direction the difference of such a pair is nearly normal, so it collides with probability
    p = P(|z| <= window), and the count of m directions is binomial (orthogonal directions only make it steadier).
    """
    p, m, total = math.erf(cfg.window / math.sqrt(2)), cfg.projections, 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > cfg.miss:
            return k
    return m


def tables(cfg: EmbeddingConfig, dims: int) -> int:
    """Tables of ``dims`` dealing projections each such that a pair at the least cosine shares a cell of one but for ``cfg.miss``.

    A difference d (nearly standard normal, in the unit of the cells) straddles no edge of a randomly shifted grid with
    probability 1 - E|d| / cell.
    """
    share = (1 - math.sqrt(2 / math.pi) / cfg.cell) ** dims
    return 1 if dims == 0 else math.ceil(math.log(cfg.miss) / math.log1p(-share))


def dealing(cfg: EmbeddingConfig, rows: int) -> tuple[int, int]:
    """(projections of a table, tables) for a label of that many distinct vectors: those of the least cost for a vector.

    Each projection leaves a vector the share ``met`` of unrelated ones in its cell, but asks for more tables.
    """
    if cfg.dims is not None:
        return cfg.dims, tables(cfg, cfg.dims)
    width = cfg.cell * math.sqrt(2 - 2 * cfg.cosine)
    far = math.erf(width / 2)
    met = far - 2 / (width * math.sqrt(math.pi)) * (1 - math.exp(-(width**2) / 4))
    dims = min(range(65), key=lambda k: tables(cfg, k) * (rows * met**k + cfg.copy))
    return dims, tables(cfg, dims)


@lru_cache(maxsize=8)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """n random directions, in orthonormal sets of up to ``dim``: (dim, n)."""
    rng, out = np.random.default_rng(seed), []
    while sum(q.shape[1] for q in out) < n:
        out.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(out, axis=1)[:, :n]


def spread(cfg: EmbeddingConfig, dim: int) -> float:
    """Standard deviation of the difference of a pair at the least cosine on a random direction."""
    return math.sqrt(2 - 2 * cfg.cosine) / math.sqrt(dim)


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """Number of projections on which row j of ``b`` lies in the window around row i of ``a``: (len(a), len(b)).

    Each projection of b is sorted once; a query's window is then a range of the order, found by two bisections, and
    all windows of the projection are laid down by one running sum.
    """
    count = np.zeros((len(a), len(b)), dtype=np.int16)
    row = np.arange(len(a))
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        s = b[order, j]
        lo, hi = np.searchsorted(s, a[:, j] - half, "left"), np.searchsorted(s, a[:, j] + half, "right")
        mark = np.zeros((len(a), len(b) + 1), dtype=np.int8)
        np.add.at(mark, (row, lo), 1)
        np.add.at(mark, (row, hi), -1)
        count[:, order] += np.cumsum(mark[:, :-1], axis=1, dtype=np.int8)
    return count


def cells_of(unit: np.ndarray, cfg: EmbeddingConfig, dims: int, n_tables: int) -> np.ndarray:
    """Cell of each unit vector in every table, as one number a table: (rows, tables)."""
    size, n = unit.shape[1], dims * n_tables
    shift = np.random.default_rng(cfg.seed + 2).random(n)
    z = unit @ directions(size, n, cfg.seed + 1) / (spread(cfg, size) * cfg.cell) + shift if n else np.zeros((len(unit), 0))
    grid = np.floor(z).astype(np.int64).astype(np.uint64).reshape(len(unit), n_tables, dims)
    code = np.tile(mix(np.arange(1, n_tables + 1, dtype=np.uint64)), (len(unit), 1))
    for j in range(dims):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, j])
    return code.view(np.int64)


def verified(unit: np.ndarray, i: np.ndarray, j: np.ndarray, fresh_pair, cfg: EmbeddingConfig) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs, those with the needed count of collisions that ``fresh_pair`` accepts and the least cosine."""
    dim = unit.shape[1]
    half, need = cfg.window * spread(cfg, dim), needed_count(cfg)
    p = unit @ directions(dim, cfg.projections, cfg.seed)
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none)]
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        enough = (np.abs(p[x] - p[y]) <= half).sum(axis=1) >= need
        x, y = x[enough], y[enough]
        new = fresh_pair(x, y)
        x, y = x[new], y[new]
        keep = np.einsum("ij,ij->i", unit[x], unit[y]) >= cfg.cosine
        found.append((x[keep], y[keep]))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def candidates(unit: np.ndarray, one: np.ndarray, two: np.ndarray, cfg: EmbeddingConfig, first: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows ``one`` with rows ``two`` whose collisions on the first projections may reach the needed count."""
    first = min(first, cfg.projections)
    p = unit @ directions(unit.shape[1], cfg.projections, cfg.seed)[:, :first]
    early = collisions(p[one], p[two], cfg.window * spread(cfg, unit.shape[1]))
    i, j = np.nonzero(early >= needed_count(cfg) - (cfg.projections - first))
    return one[i], two[j]


def pairs_in_runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with the same code, each pair once; for codes that few rows share."""
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    end = np.searchsorted(sorted_code, sorted_code, "right")
    after = end - np.arange(len(code)) - 1
    i = np.repeat(np.arange(len(code)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    return order[i], order[j]


def node_key() -> F.Column:
    """128 bits of label and vector (in double precision), as text: what equal vectors of a label share."""
    vector = F.col("embedding").cast("array<double>")
    return F.concat_ws(":", F.hex(F.xxhash64("label", vector)), F.hex(F.xxhash64(F.lit(1), vector, "label")))


def embedding_links(vectors: DataFrame, cfg: EmbeddingConfig = EmbeddingConfig()) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their links: (nodes, links).

    nodes: node (128 bits of label and vector), label, embedding, copies, least (smallest vec_id), n_links (vectors
    linked with each copy, copies of its own included); links: (a, b) node pairs that span the components.

    Equal vectors of a label collapse to one node first, so copies cost one row. Nodes are dealt to the cells of several
    randomly shifted grids over a few projections each (``dealing``); only their numbers are exploded, counted and
    placed, and vectors travel once for each cell that holds another node. A pair counts in the first table where it
    meets. A hot cell is cut into tiles of bounded sides; nodes whose largest hot cell is the same are compared there
    alone, and the largest such group of another table's cell skips its pairs there, so a hot group is compared with
    itself about once and not once a table. No pair leaves a tile: only counts and spanning links do.
    """
    usable = (
        "label is not null and embedding is not null and size(embedding) > 0 and "
        "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    nodes = cut(
        vectors.where(usable).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
        .groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", node_key())
    )
    sizes = nodes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("rows"))
    placed = nodes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"]).select("node", "label", "dim", "rows", "copies", "embedding")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                d, rows = batch.column("dim").to_numpy(), batch.column("rows").to_numpy()
                flat, ends = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(d)))
                codes = [None] * len(d)
                for size, n in {(int(x), int(y)) for x, y in zip(d, rows, strict=True)}:
                    mine = np.flatnonzero((d == size) & (rows == n))
                    v = flat[ends[mine][:, None] + np.arange(size)]
                    v = v / np.linalg.norm(v, axis=1, keepdims=True)
                    for k, code in zip(mine.tolist(), cells_of(v, cfg, *dealing(cfg, n)), strict=True):
                        codes[k] = code
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    label_type = vectors.schema["label"].dataType.simpleString()
    placed = cut(placed.mapInArrow(place, f"node string, label {label_type}, dim int, rows long, copies long, embedding array<double>, codes array<long>"))
    cell = ["label", "dim", "t", "code"]
    dealt = placed.select("node", "label", "dim", "rows", F.posexplode("codes").alias("t", "code"))
    counts = cut(dealt.groupBy(cell).agg(F.count("*").alias("n")).where("n > 1"))
    best = (
        dealt.join(counts.where(F.col("n") > cfg.hot), cell)
        .groupBy("node").agg(F.max(F.struct("n", "t", "code")).alias("top")).select("node", F.col("top.t").alias("ht"), F.col("top.code").alias("hc"))
    )
    held = cut(dealt.join(counts, cell).join(best, "node", "left"))
    wide = held.where((F.col("n") > cfg.tile) & (F.col("ht") != F.col("t"))).groupBy(*cell, "ht", "hc").agg(F.count("*").alias("m"))
    major = wide.groupBy(cell).agg(F.max(F.struct("m", "ht", "hc")).alias("major"))
    inside = F.coalesce((F.col("ht") == F.col("major.ht")) & (F.col("hc") == F.col("major.hc")), F.lit(False))
    sides = (
        held.join(major, cell, "left").withColumn("inside", inside).withColumn("m", F.coalesce("major.m", F.lit(0)))
        .withColumn("across", F.ceil(F.col("m") / cfg.tile).cast("int")).withColumn("own", F.ceil((F.col("n") - F.col("m")) / cfg.tile).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("across")).otherwise(F.col("own"))).cast("int"))
        .where("not inside or own > 0")
        .select("*", F.explode(F.when(F.col("inside"), F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.sequence(-F.col("across"), F.col("own") - 1))).alias("j"))
    )
    first = ~F.col("inside") & ((F.col("j") < 0) | (F.col("j") >= F.col("block")))
    few = F.col("n") <= cfg.small
    tiles = sides.select(
        "node", "ht", "hc", "t", "code", first.alias("query"), few.alias("few"),
        F.when(few, F.pmod(F.col("code"), F.ceil(F.col("rows") / cfg.tile))).otherwise(F.col("code")).alias("part"),
        F.when(first, F.col("block")).otherwise(F.col("j")).alias("r"),
        F.when(F.col("inside"), -1 - F.col("block")).when(first, F.col("j")).otherwise(F.col("block")).alias("c"),
    ).join(placed.select("node", "label", "dim", "copies", "embedding", "codes"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, node, copies = (pdf[x].to_numpy() for x in ("query", "node", "copies"))
        t, codes, code = int(pdf["t"].iloc[0]), np.stack(pdf["codes"].to_numpy()), pdf["code"].to_numpy()
        ht, hc = (pdf[x].fillna(-1).to_numpy().astype(np.int64) for x in ("ht", "hc"))
        unit = np.stack(pdf["embedding"].to_numpy())
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)

        def fresh_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            together = (ht[x] >= 0) & (ht[x] == ht[y]) & (hc[x] == hc[y])
            return np.where(together, ht[x] == t, ~(codes[x, :t] == codes[y, :t]).any(axis=1))

        if pdf["few"].iloc[0]:
            i, j = pairs_in_runs(code)
        elif pdf["r"].iloc[0] == pdf["c"].iloc[0]:
            every = np.arange(len(pdf))
            i, j = candidates(unit, every, every, cfg)
            i, j = i[i < j], j[i < j]
        else:
            i, j = candidates(unit, np.flatnonzero(ask), np.flatnonzero(~ask), cfg)
        i, j = verified(unit, i, j, fresh_pair, cfg)
        links = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
        some = np.flatnonzero(links)
        span = forest(len(pdf), i, j)
        return pd.concat([
            pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "a": None, "b": None}),
            pd.DataFrame({"node": None, "links": None, "a": [node[x] for x, _ in span], "b": [node[y] for _, y in span]}),
        ]).astype({"links": "Int64"})

    found = cut(tiles.groupBy("label", "dim", "t", "few", "part", "r", "c").applyInPandas(compare, "node string, links long, a string, b string"))
    drop(placed, counts, held)
    linked = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    out = nodes.join(linked, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links")
    return out, found.where("a is not null").select("a", "b")


def embedding_duplicates(vectors: DataFrame, cfg: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    cfg.cosine. Null and zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths don't either; repeated rows link with each other; an empty table gives no rows. A null vec_id
    counts in no minimum. Other columns are not read.
    """
    nodes, links = embedding_links(vectors, cfg)
    nodes = cut(nodes.select("node", "label", "embedding", "least", "n_links"))
    parts = connected_components(links)
    joined = nodes.join(parts, nodes.node == parts.id, "left").withColumn("component", F.coalesce("component", "node"))
    first = joined.groupBy("component").agg(F.min("least").alias("first"))
    known = joined.join(first, "component").select("node", "n_links", "first")
    rows = vectors.select("vec_id", node_key().alias("_h"), F.col("label").isNotNull().alias("_l"))
    return rows.join(known, (rows["_h"] == known["node"]) & rows["_l"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("first", "vec_id") == F.col("vec_id"), F.col("first").isNull()).alias("kept"),
    )
