"""Vector near-dedup against all pairs, and the recall of its filters."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import queries, vectors

KINDS = "vec_id long, embedding array<double>"


def unit(rng, n, d=64):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(rng, x, cosine):
    """For each row a random unit vector at this cosine."""
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def brute(rows, cosine=0.95):
    ok = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for a, x in ok:
        for b, y in ok:
            if a != b and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.linalg.norm(x1) / np.linalg.norm(y1) >= cosine:
                    near[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, left = {k}, [k]
        while left:
            new = near[left.pop()] - seen
            seen |= new
            left += new
        low = min((rows[o][0] for o in seen if rows[o][0] is not None), default=None)
        out.append((i, len(near[k]), low, i == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("cosine", [0.951, 0.97, 0.99])
@pytest.mark.parametrize("n", [2_000, 50_000, 5_000_000])
def test_recall_of_filters(cosine, n):
    """Pairs just above the threshold, with the filters of a table of n vectors."""
    rng = np.random.default_rng(n)
    x = unit(rng, 1500)
    cap = vectors.cap_for(n)
    words = vectors.words_for(n, cap)
    a, b = vectors.decode(x, words, cap), vectors.decode(turned(rng, x, cosine), words, cap)
    assert np.mean([len(set(p) & set(q)) > 0 for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= (0.97 if cosine < 0.96 else 0.99)


def test_decoding_finds_the_nearest_filters():
    x = unit(np.random.default_rng(4), 40, 10)
    turn, blocks, books = vectors.product_code(10, 6, 3)
    y, every = x @ turn, np.zeros((40, 1))
    for block, book in zip(blocks, books, strict=True):
        every = (every[:, :, None] + (y[:, block] @ book.T)[:, None, :]).reshape(40, -1)
    assert (vectors.decode(x, 6, 5, 3) == np.sort(np.argsort(-every, axis=1)[:, :5], axis=1)).all()


def some(rng):
    x = unit(rng, 120)
    near = [turned(rng, x[:20], c) for c in (0.9, 0.96, 0.99)]
    crowd = turned(rng, np.repeat(x[20:21], 60, axis=0), 0.985)
    vecs = [v.tolist() for v in np.concatenate([x, *near, crowd])] + [(7 * x[3]).tolist(), (x[4] * 1e200).tolist(), (x[4] * 1e-200).tolist()]
    rows = [(1000 + i if i % 2 else 500 - i, v) for i, v in enumerate(vecs)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None], [float("inf")] + [0.0] * 63, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    return rows + [(9000 + i, v) for i, v in enumerate(odd)] + [(None, vecs[0]), (None, vecs[0]), rows[5], rows[5], (77, vecs[7]), (None, [5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("side", [vectors.SIDE, 7])
def test_dedup(spark, side):
    rows = some(np.random.default_rng(3))
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit("x") for c in ("cls", "n", "id", "vector", "filter", "links", "label")}).repartition(4)
    want = brute(rows)
    got = [tuple(r) for r in vectors.dedup(df, side=side, cap=24).collect()]  # so many filters that none of these pairs is missed
    assert sorted(got, key=str) == want


def test_no_link_is_false_and_few_are_missed(spark):
    rng = np.random.default_rng(11)
    x = unit(rng, 1200)
    both = np.concatenate([x, turned(rng, x[:400], 0.955)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], KINDS)
    n = {r.vec_id: r.n_links for r in vectors.dedup(df).collect()}
    true = (both @ both.T >= 0.95).sum(axis=1) - 1
    assert all(n[i] <= true[i] for i in n) and sum(n.values()) >= 0.98 * true.sum()


def test_empty(spark):
    assert vectors.dedup(spark.createDataFrame([], KINDS)).collect() == []
    got = vectors.dedup(spark.createDataFrame([(3, None), (None, [0.0])], KINDS)).collect()
    assert sorted(map(tuple, got), key=str) == [(3, 0, 3, True), (None, 0, None, True)]


def test_query_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = unit(rng, 150).astype(np.float32)
    both = np.concatenate([x, turned(rng, x[:30], 0.98), turned(rng, np.repeat(x[40:41], 25, axis=0), 0.99), x[60:63]])
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(both)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for folder, found in (("/root/testdata/sf0.001", "embeddings.parquet"), (str(tmp_path), "embeddings.parquet/*.parquet")):
        c = duckdb.connect()
        c.execute(f"create view embeddings as select * from '{os.path.join(folder, found)}'")
        assert sorted(map(tuple, queries.op12_vectors(spark, folder).collect())) == sorted(c.execute(queries.OP12_SQL).fetchall())
