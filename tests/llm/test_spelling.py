"""Spelling variants against a plain version, the automaton against sets, and the query against SQL."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from undula.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
KINDS = "doc_id long, text string"


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    out = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain(rows):
    n = plain_counts(rows)
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, os_ in others.items():
        best = min(os_, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    def last(w):
        return w if form[w] is None else last(form[w])
    return sorted(((w, form[w], last(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def some(rnd):
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 11))) for _ in range(12)] + ["aaaaaaaa", "abababab", "straßenÀ", "z" * 3000]
    def changed(w):
        p, c = rnd.randrange(len(w)), rnd.choice("abéß")
        return rnd.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :], w[:p] + c + w[p:]])
    text = lambda: " ".join(rnd.choice([rnd.choice(base), rnd.choice(base).upper(), changed(rnd.choice(base)), changed(changed(rnd.choice(base))), "日本", "x×÷y", "a1b", "short"]) for _ in range(rnd.choice([0, 3, 60])))
    rows = [(i, text()) for i in range(80)]
    ladder = " ".join(["conduction"] * 1000 + ["conductior"] * 90 + ["conductxor"] * 5)  # a form's form
    return [*rows, (None, rows[2][1]), (None, rows[2][1]), (5, rows[5][1]), (81, None), (82, ""), (83, "\x00,.;"), (84, ladder), (85, "long words " * 5000)]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", max_size=6), min_size=1, max_size=40), st.text("abc", max_size=6), st.integers(0, 6))
def test_automaton(words, word, exact):
    ordered = sorted(words)
    a = spelling.Automaton(ordered)
    for k, w in enumerate(ordered):
        state, number = a.walk(0, 0, w)
        assert a.final[state] and number == k
    exact = min(exact, len(word))
    ends = lambda w: w[:exact] == word[:exact] and (w[exact:], word[exact:])
    want = {k for k, w in enumerate(ordered) if w[:exact] == word[:exact] and near(*ends(w))}
    assert a.near(word, exact) == want


def test_automaton_is_minimal():
    """As many states as there are different sets of endings."""
    words = sorted(a + b + c for a in "abcd" for b in ("xy", "z") for c in ("ing", "ed", ""))
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert spelling.Automaton(words).n_states == len(set(endings.values()))


@pytest.mark.parametrize(("crowd", "points"), [(spelling.CROWD, spelling.POINTS), (4, 100), (1, 1)])
def test_variants(spark, monkeypatch, crowd, points):
    rows = some(random.Random(2))
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit("x") for c in ("word", "n", "key", "back", "part", "form", "best")}).repartition(3)
    got = sorted(map(tuple, spelling.variants(df, crowd=crowd, points=points).collect()), key=str)
    assert got == plain(rows)
    assert any(w[1] and w[2] != w[1] for w in got)  # a chain


def test_counts_over_slices(spark, monkeypatch):
    rows = some(random.Random(4))
    df = spark.createDataFrame(rows, KINDS).coalesce(1)
    assert {r.word: r.n for r in spelling.words(df).collect()} == plain_counts(rows)
    text = rows[0][1] + " " + rows[1][1]
    monkeypatch.setattr(spelling, "_SLICE", 5)
    assert [w for some_ in spelling._runs(text, 7) for w in some_] == [r.translate(LOW).encode("latin-1") for r in RUN.findall(text) if len(r) >= 7]


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], KINDS)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (None, None), (2, "one two")], KINDS)).collect() == []


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(some(random.Random(9)), KINDS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for folder, found in (("/root/testdata/sf0.001", "documents.parquet"), (str(tmp_path), "documents.parquet/*.parquet")):
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{os.path.join(folder, found)}'")
        assert sorted(map(tuple, queries.op11_spelling(spark, folder).collect()), key=str) == sorted(c.execute(queries.OP11_SQL).fetchall(), key=str)
