"""Near duplicates among vectors by an epsilon grid order join.

A cosine of c or more is a distance of at most sqrt(2 - 2c) between unit vectors, and no less on any principal
dimensions. Vectors, sorted by their grid cells on the leading ones, are cut into blocks; pairs of intervals of this
sequence are halved again and again, leaving out those whose bounding boxes are too far apart. The blocks of the pairs that
remain meet in tiles, some neighbouring blocks with some others, so that a block travels once for several of its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored
from .components import components

#: Vectors of a block; rows of a block that are compared at once; blocks of a tile, at most, and bytes of it.
BLOCK, STRIP, TILE, TILE_BYTES = 2048, 256, 4, 32 << 20
#: Tiles of one row that a strip has, once there are so many tiles for each of them; partitions that strips are dealt to.
STRIP_TILES, MANY_TILES, PARTITIONS = 16, 512, 20_000
#: Principal dimensions of the grid order and of the bounding boxes; further ones by which these are found.
GRID_DIMS, BOX_DIMS, MORE_DIMS = 8, 24, 8


def _matrix(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(rows: DataFrame, dim: int, id_col: str, column: str, kind: str) -> DataFrame:
    """(vec, key, x): x: the vector's numbers, filled up with zeros to dim; key: its digest; both null where it can't link. Stored."""

    def read(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), 0).astype(np.int64)
            values = lists.flatten()  # of lists that aren't null
            values = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            row = np.repeat(np.arange(len(size)), size)
            x = np.zeros((len(size), dim), kind)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values + 0.0  # -0.0 becomes 0.0
            ok = b.column(0).is_valid().to_numpy(zero_copy_only=False) & (size > 0) & np.isfinite(x).all(axis=1) & x.any(axis=1)
            xs = [v.tobytes() if good else None for v, good in zip(x, ok.tolist(), strict=True)]
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in xs]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(xs, pa.binary())], ["vec", "key", "x"])

    return stored(rows.select(F.col(id_col).cast("long").alias("vec"), F.col(column).alias("v")).mapInArrow(read, "vec long, key binary, x binary"), "vectors")


def principal_axes(classes: DataFrame, dim: int, kind: str, rounds: int = 2) -> np.ndarray:
    """The leading principal directions of all unit vectors, as columns: by rounds of products with the covariance, each a pass over the vectors.

    The driver gets dim rows for each direction asked for. Whatever the directions are, distances along them are none too
    large, so results don't depend on how good they are.
    """
    some = min(dim, BOX_DIMS + MORE_DIMS)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(dim, some)))[0]
    for _ in range(rounds):

        def sums(batches, q=q):
            n, s, sq = 0, np.zeros(dim), np.zeros((dim, some))
            for b in batches:
                if b.num_rows:
                    u = _unit(_matrix(b.column(0), dim, kind))
                    n, s, sq = n + len(u), s + u.sum(axis=0), sq + u.T @ (u @ q)
            if n:
                out = np.concatenate([[n], s, sq.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "v"])

        parts = classes.select("x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        v = parts.sort_values("i")["v"].to_numpy()
        mean = v[1 : dim + 1] / v[0]
        found = v[dim + 1 :].reshape(dim, some) / v[0] - np.outer(mean, mean @ q)
        q = np.linalg.svd(found, full_matrices=False)[0]
    return q.copy()


def blocks(classes: DataFrame, axes: np.ndarray, eps: float, dim: int, size: int, kind: str) -> DataFrame:
    """(block, ids, counts, x, lo, hi): the classes in epsilon grid order, size to a block, with its bounding box. Stored."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                p = _unit(_matrix(b.column(2), dim, kind)) @ shared.value[:, :GRID_DIMS]
                cell = np.clip(np.floor(p / eps) + 128, 0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in cell], pa.binary()), pa.array(p[:, 0])], [*b.schema.names, "cell", "first"])

    def numbered(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(b.num_rows, part)), pa.array(np.arange(n, n + b.num_rows))], ["rep", "n", "x", "part", "at"])
            n += b.num_rows

    keyed = classes.select("rep", "n", "x").mapInArrow(cells, "rep long, n long, x binary, cell binary, first double")
    ordered = keyed.repartitionByRange("cell", "first", "rep").sortWithinPartitions("cell", "first", "rep")
    ordered = stored(ordered.mapInArrow(numbered, "rep long, n long, x binary, part long, at long"), "ordered")
    before, offsets = 0, []
    for part, n in ordered.groupBy("part").count().orderBy("part").toLocalIterator():  # a row per partition
        offsets.append((part, before))
        before += n
    offsets = ordered.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, before long")
    placed = ordered.join(F.broadcast(offsets), "part").select(((F.col("before") + F.col("at")) / size).cast("long").alias("block"), "rep", "n", "x")

    def pack(table: pa.Table) -> pa.Table:
        rep, n = (table.column(c).to_numpy() for c in ("rep", "n"))
        x = _matrix(table.column("x"), dim, kind)
        p = _unit(x) @ shared.value[:, :BOX_DIMS]
        return pa.table({"block": table.column("block")[:1], "ids": pa.array([rep.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "x": pa.array([x.astype(kind).tobytes()], pa.binary()), "lo": [p.min(axis=0)], "hi": [p.max(axis=0)]})

    return stored(placed.groupBy("block").applyInArrow(pack, "block long, ids binary, counts binary, x binary, lo array<double>, hi array<double>"), "blocks")


def near_blocks(boxes: DataFrame, count: int, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks (block, lo, hi) whose boxes are within eps: from the whole sequence down, interval by interval."""
    levels = max(0, (count - 1).bit_length())
    each = stored(boxes.select("block", F.posexplode(F.arrays_zip("lo", "hi"))).select("block", "pos", "col.lo", "col.hi"), "boxes")
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        node = F.shiftright("block", level).alias("node")
        box = each.groupBy(node, "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("box"))
        halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        pairs = pairs.select(halves("a"), "b").select("a", halves("b")).filter("a <= b")
        pairs = pairs.join(box.select(F.col("node").alias("a"), F.col("box").alias("p")), "a").join(box.select(F.col("node").alias("b"), F.col("box").alias("q")), "b")
        gap = F.zip_with("p", "q", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
        pairs = pairs.filter(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps).select("a", "b")
    return stored(pairs, "block-pairs")


def _labels(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each end of links (i, j) between ids a and ids b reaches."""
    la, lb = a.copy(), b.copy()
    while len(i):
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, i, nb[j])
        np.minimum.at(nb, j, na[i])
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return la, lb


def _compared(a, b, cosine: float, eps: float):
    """(ids, links, least) of the rows of two blocks (or of one with itself) that have links there: their number, copies counted, and the least id reached. A block: (number, ids, counts, unit vectors, places on the axes, box)."""
    x, y, p, q = a[3], b[3], a[4], b[4]
    left, right = [], []
    for s in range(0, len(x), STRIP):
        for t in range(s if a is b else 0, len(y), STRIP):
            ps, qs = p[s : s + STRIP], q[t : t + STRIP]
            if _gap(ps.min(axis=0), ps.max(axis=0), qs.min(axis=0), qs.max(axis=0)) <= eps * eps:
                i, j = np.nonzero(x[s : s + STRIP] @ y[t : t + STRIP].T >= cosine)
                if a is b and s == t:
                    i, j = i[i < j], j[i < j]
                left.append(i + s)
                right.append(j + t)
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    if not len(i):
        return
    ca, cb = np.bincount(i, b[2][j], len(x)), np.bincount(j, a[2][i], len(y))
    if a is b:
        out = [(a[1], ca + cb, _labels(np.r_[i, j], np.r_[j, i], a[1], a[1])[0])]
    else:
        la, lb = _labels(i, j, a[1], b[1])
        out = [(a[1], ca, la), (b[1], cb, lb)]
    for ids, c, least in out:
        has = c > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(c[has].astype(np.int64)), pa.array(least[has])], ["rep", "links", "least"])


def _gap(lo, hi, lo2, hi2) -> float:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float((gap * gap).sum())


def block_links(pairs: DataFrame, held: DataFrame, cosine: float, eps: float, axes: np.ndarray, dim: int, size: int, kind: str) -> DataFrame:
    """(rep, links, least): for each pair of near blocks (a, b) and vector that has links in it their number, copies counted, and the least id reached. Stored.

    Pairs are put together to tiles, and tiles of one row to strips of up to STRIP_TILES. A strip's rows come sorted: first the
    blocks of its row, which are held, then those of one tile after the other; those whose boxes are near are compared. A
    partition has many strips, PARTITIONS of them at the most: rows are sorted on disk, and memory holds two sides of a tile.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(axes)
    side = max(1, min(TILE, TILE_BYTES // (size * dim * 8)))

    def compare(batches):
        strip, at, row, tile = None, None, [], []

        def told():
            own = row is tile
            if own and strip[0] // tiles_of != strip[1]:  # the row's own tile is another strip's
                return
            for k, a in enumerate(row):
                for b in tile[k:] if own else tile:
                    if _gap(*a[5], *b[5]) <= eps * eps:
                        yield from _compared(a, b, cosine, eps)

        for batch in batches:
            for r in range(batch.num_rows):
                u, w, t, block, ids, n, x = (c[r].as_py() for c in batch.columns)
                if ((u, w), t) != (strip, at):
                    if strip:
                        yield from told()
                    tile = []
                    if (u, w) != strip:
                        strip, row = (u, w), tile
                    at = t
                x = _unit(np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64))
                p = x @ shared.value[:, :BOX_DIMS]
                tile.append((block, np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64), x, p, (p.min(axis=0), p.max(axis=0))))
        if strip:
            yield from told()

    tiles = stored(pairs.select(F.floor(F.col("a") / side).alias("u"), F.floor(F.col("b") / side).alias("v")).distinct(), "tiles")
    count = tiles.count()
    tiles_of = max(1, min(STRIP_TILES, count // MANY_TILES))
    strips = F.floor(F.col("v") / tiles_of).alias("w")
    wanted = tiles.select("u", strips, F.explode(F.array("u", "v")).alias("t")).distinct()
    blocks_of = held.select(F.floor(F.col("block") / side).alias("t2"), "block", "ids", "counts", "x")
    both = wanted.join(blocks_of, F.col("t") == F.col("t2")).select("u", "w", "t", "block", "ids", "counts", "x")
    both = both.repartition(max(1, min(PARTITIONS, -(-count // tiles_of))), "u", "w").sortWithinPartitions("u", "w", "t", "block")
    return stored(both.mapInArrow(compare, "rep long, links long, least long"), "vector-links")


def near_duplicates(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec, n_links, component): a row per row: how many other rows link with it, and the least id that links reach.

    Rows link when their cosine, in doubles, is at least the given one. Null or zero vectors, those with null or non-finite
    elements, and rows without an id link with nothing. Equal vectors are compared once and counted as often as they
    occur; shorter vectors are filled up with zeros. Rows that share an id are one node of a component. Extra columns
    aren't read.
    """
    kind = "<f4" if rows.schema[column].dataType.simpleString() == "array<float>" else "<f8"  # what the vectors have been read as is what travels
    eps = math.sqrt(2 - 2 * cosine) + 1e-6
    dim = rows.agg(F.max(F.size(column))).first()[0]
    dim = max(1, dim or 0)
    held = vectors(rows, dim, id_col, column, kind)
    classes = stored(held.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")), "vector-classes")
    count = classes.count()
    if count:
        axes = principal_axes(classes, dim, kind)
        packed = blocks(classes, axes, eps, dim, block, kind)
        found = block_links(near_blocks(packed.select("block", "lo", "hi"), -(-count // block), eps), packed, cosine, eps, axes, dim, block, kind)
    else:
        found = rows.sparkSession.createDataFrame([], "rep long, links long, least long")
    labels = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rep", "n").join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = stored(known.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-classes")
    out = held.select("vec", "key").join(known, F.col("key") == F.col("k"), "left")
    return out.select("vec", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return df.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))


OP10_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = e.vec_id"""
