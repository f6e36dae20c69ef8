"""Importance resampling against a plain version and against SQL."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from undula.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
KINDS = "doc_id long, text string"


def plain_features(text, run=2):
    ws = WORD.findall((text or "").translate(LOW))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in range(1, run + 1) for i in range(len(ws) - k + 1)]


def plain(rows, target):
    fs = [(i, *plain_features(t)) for i, t in rows]
    s, t = {}, {}
    for found, to in ((fs, s), ([(0, *plain_features(x)) for x in target], t)):
        for _, _, buckets in found:
            for b in buckets:
                to[b] = to.get(b, 0) + 1
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, n, buckets in fs:
        gain = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + 10000) / ((s.get(b, 0) + 1) * (all_t + 10000)))) for b in buckets]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * 25 // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def some(rnd, n):
    words = ["The", "étude", "日本", "x1", "AND", "of", "ÀB", "a-b", "q\x00r", *(f"w{i}" for i in range(40))]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 19, 20, 21, 60])))
    rows = [(i, text()) for i in range(n)]
    return [*rows, (None, text()), (None, text()), (n, None), (n + 1, ""), (n + 2, " ,.;\n"), (3, rows[3][1]), (n + 3, "long one " * 3000), (n + 4, "y" * 5000 + " z")], [text() for _ in range(15)] + [None, ""]


@pytest.mark.parametrize("run", [1, 2, 3])
def test_features_over_slices(monkeypatch, run):
    rnd = random.Random(run)
    monkeypatch.setattr(importance, "_SLICE", 7)
    for text in ["", "a", "a b", "A1 b2,c3", " ".join(rnd.choice(["ab", "é", "c" * 20, "x y", "-"]) for _ in range(300)), "w" * 100]:
        n, keys, counts = importance.features(text.encode(), run)
        words, want = plain_features(text, run)
        assert n == words and sorted(b for k, c in zip(keys, counts, strict=True) for b in [k] * c) == sorted(want)


def test_resample(spark, monkeypatch):
    rows, target = some(random.Random(8), 150)
    docs = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit("x") for c in ("rank", "place", "words", "n", "score", "_at")}).repartition(4)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in importance.resample(docs, goal).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, target), key=str)
    monkeypatch.setattr(importance, "_SLICE", 50)
    assert sorted((tuple(r) for r in importance.resample(docs.coalesce(1), goal).collect()), key=str) == sorted(got, key=str)


def test_equal_rows_and_empty_tables(spark):
    rows = [(1, "one two three four five " * 5)] * 40 + [(None, "one two three four five " * 5)] * 8
    docs, none = spark.createDataFrame(rows, KINDS), spark.createDataFrame([], KINDS)
    got = importance.resample(docs, docs).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 13)) and len(got) == 48
    assert importance.resample(none, docs).collect() == []
    assert len(importance.resample(docs, none).collect()) == 48


def test_blocks_hold_every_document_once(spark):
    rows, _ = some(random.Random(2), 90)
    blocks = importance.matrix(spark.createDataFrame(rows, KINDS).repartition(3)).collect()
    assert sorted((i for b in blocks for i in b.doc_ids), key=str) == sorted((i for i, _ in rows), key=str)
    for b in blocks:
        assert len(b.starts) == len(b.doc_ids) + 1 == len(b.words) + 1 and b.starts[-1] == len(b.buckets) == len(b.counts)
    with pytest.raises(ValueError):
        importance.matrix(spark.createDataFrame(rows, KINDS), buckets=1 << 20)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for p in os.listdir(sf):
        c.execute(f"create view {p[:-8]} as select * from '{sf}/{p}'")
    want = c.execute(queries.OP13_SQL).fetchall()
    got = queries.op13_importance(spark, sf)
    assert got.dtypes == [(x, "bigint") for x in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
