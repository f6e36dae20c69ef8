"""Near-duplicate vectors by spherical-cap filters.

Filters are the directions of a random product code: a random rotation, `PARTS` blocks of coordinates, and a codebook of random directions for each block; a filter takes
one word of each book, so a few books of B words span B**PARTS directions that are never listed. Decoding a vector gives all filters in its cap: block by block only the
best partial sums are kept, which is exact, since a better beginning stays better under any end. The cap's height is the vector's own: it holds its nearest filters, half as many as the logarithm of the number of vectors.
(With one height for all vectors, those whose rotated blocks are of unequal length fall into hundreds of filters and others into none: at 6 filters a vector on average,
pairs of cosine 0.95 met in 76% of cases; with own heights in 99.1%, at 8 filters in 99.8%. Higher caps of more filters lose more, so their number grows. Tests measure it.) Vectors that share a filter are
compared in double precision; only pairs of at least `COSINE` count. The number of filters grows with that of vectors, so that one holds about `FILL` of them.

Equal vectors are one class, compared once. A pair is counted under the smallest filter that both have, so links need no list of pairs: each filter hands out, for each of its
vectors, a number of links and the smallest vector that it is connected to there. A filter of more than `SIDE` vectors is cut into blocks and each two blocks are a group
of their own, so no group holds more than two blocks; the work still grows with the square of a crowd of different near-equal vectors, as each pair is verified.

Null vectors, vectors of length 0 and those with null or non-finite components link with nothing; so do vectors of different dimensions. Rows are rows: a repeated id counts
as often as it occurs. A null id never names a component, unless no other row is in it. Ties of filters go either way, as equal vectors are one class anyway. An empty table gives no
rows. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import few, materialize, trim
from undula.llm.components import components

COSINE, LEAST_CAP, PARTS, FILL, SIDE, SEED = 0.95, 6, 2, 256, 1024, 12


@lru_cache(maxsize=4)
def product_code(dim: int, words: int, parts: int = PARTS, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A rotation, the coordinates of each block, and each block's book of unit vectors."""
    rng = np.random.default_rng([seed, dim, words, parts])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks = [b for b in np.array_split(np.arange(dim), parts) if len(b)]
    books = [rng.standard_normal((words, len(b))) for b in blocks]
    return turn, blocks, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]


def _best(sums: np.ndarray, most: int) -> np.ndarray:
    """The places of the largest `most` values of each row."""
    return np.argpartition(-sums, most - 1, axis=1)[:, :most] if sums.shape[1] > most else np.tile(np.arange(sums.shape[1]), (len(sums), 1))


def decode(unit: np.ndarray, words: int, cap: int, parts: int = PARTS, seed: int = SEED) -> np.ndarray:
    """The numbers of the filters in the cap of each unit vector, a row each, ascending."""
    turn, blocks, books = product_code(unit.shape[1], words, parts, seed)
    turned, every = unit @ turn, np.arange(len(unit))[:, None]
    total, filters = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for block, book in zip(blocks, books, strict=True):
        near = turned[:, block] @ book.T
        word = _best(near, cap)
        sums = (total[:, :, None] + near[every, word][:, None, :]).reshape(len(unit), -1)
        numbers = (filters[:, :, None] * words + word[:, None, :]).reshape(len(unit), -1)
        top = _best(sums, cap)
        total, filters = sums[every, top], numbers[every, top]
    return np.sort(filters, axis=1)


def cap_for(n: int) -> int:
    """Filters of each of n vectors."""
    return max(LEAST_CAP, math.ceil(math.log2(n + 1) / 2))


def words_for(n: int, cap: int, parts: int = PARTS, fill: int = FILL) -> int:
    """Words of a book, so that filters hold about `fill` of n vectors."""
    return max(2, math.ceil((n * cap / fill) ** (1 / parts)))


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of one dimension as unit vectors in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> DataFrame:
    """cls, dim, vector, n (rows), first (smallest id) of the different vectors that can link. rows: id, vector."""
    v = F.col("vector")
    good = rows.filter(F.size(v) > 0).filter(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0))
    found = good.groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return materialize(found.select(F.monotonically_increasing_id().alias("cls"), F.size("vector").alias("dim"), "vector", "n", "first"))


def filtered(vectors: DataFrame, cap: int | None = None, parts: int = PARTS, fill: int = FILL, seed: int = SEED) -> DataFrame:
    """vectors (classes) with `filters`, the ascending numbers of the filters of each."""
    n = vectors.count()
    cap = cap or cap_for(n)
    words = words_for(n, cap, parts, fill)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)

    def go(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                for at in range(0, own.num_rows, step := max(1, (1 << 22) // max(words, int(d)))):
                    piece = own.slice(at, step)
                    found = decode(units(piece.column("vector")), words, cap, parts, seed)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=[*piece.schema.names, "filters"])
        trim()

    return vectors.mapInArrow(go, f"{kinds}, filters array<long>")


def stars(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest row that each row is connected to."""
    root = np.arange(len(near))
    left = near.any(axis=1)
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        own = np.zeros(len(near), dtype=bool)
        own[i] = True
        edge = own
        while edge.any():
            edge = near[edge].any(axis=0) & ~own
            own |= edge
        root[own], left[own] = i, False
    return root


def _compare(cosine: float):
    def go(group: pa.Table) -> pa.Table:
        t = group.sort_by("cls").combine_chunks()
        cls, n, side = (t.column(c).to_numpy() for c in ("cls", "n", "side"))
        here, lists = t.column("filter")[0].as_py(), t.column("filters").combine_chunks()
        x = units(t.column("vector").combine_chunks())
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if t.column("one")[0].as_py() != t.column("two")[0].as_py():
            near &= side[:, None] != side[None, :]
        # pairs that share a smaller filter are counted there
        row, number = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        early = number < here
        found, at, times = np.unique(number[early], return_inverse=True, return_counts=True)
        shared = times[at] > 1
        if shared.any() and near.any():
            has = np.zeros((len(t), len(found)), np.float32)
            has[row[early][shared], at[shared]] = 1
            has = has[:, times > 1]
            near &= has @ has.T == 0
        links, root = near @ n, stars(near)
        keep = links > 0
        return pa.table({"cls": cls[keep], "links": links[keep].astype(np.int64), "root": cls[root[keep]]})

    return go


def compare(vectors: DataFrame, cosine: float = COSINE, side: int = SIDE) -> DataFrame:
    """cls, links, root of every vector in every group where it has links. vectors: filtered(), written."""
    at = vectors.select("cls", "dim", F.explode("filters").alias("filter"))
    crowds = materialize(at.groupBy("dim", "filter").agg(F.count("*").alias("n_here")).filter(F.col("n_here") > side).select("dim", "filter", F.ceil(F.col("n_here") / side).cast("int").alias("blocks")))
    rows = vectors.select("cls", "dim", "n", "vector", "filters", F.explode("filters").alias("filter"))
    rows = rows.join(few(crowds), ["dim", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # at most one row for each `side` rows
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cls", "dim", "n", "vector", "filters", "filter", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
    return rows.groupBy("dim", "filter", "one", "two").applyInArrow(_compare(cosine), "cls long, links long, root long")


def dedup(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, cap: int | None = None, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    vectors = materialize(filtered(classes(rows), cap))
    found = materialize(compare(vectors, cosine, side))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("root").alias("a"), F.col("cls").alias("b")).filter("a != b"))
    first = vectors.select("cls", "first")
    names = joined.join(first, joined.node == first.cls).groupBy("component").agg(F.min("first").alias("name"))
    named = joined.join(names, "component").select(F.col("node").alias("cls"), "name")
    per = vectors.select("cls", "vector", "n", "first").join(links, "cls", "left").join(named, "cls", "left")
    per = per.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "first").alias("name")).filter("n_links > 0")
    out = rows.join(per, "vector", "left").select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
