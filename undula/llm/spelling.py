"""Spelling variants: words that differ by one inserted, deleted or replaced code point, each with the much more frequent word that it is a form of.

Words are found and counted in the tasks that read the texts. One error leaves a word's first or its second half as it is, so a word looks for its near words among those that
begin as it does, and among those that end as it does: such words meet in one group. A task builds a minimal acyclic automaton of the words of some groups, forward or of
the words reversed, follows a word's exact half, then completes it with one error anywhere in the rest. The automaton numbers its words, so that a state stands for many
words and the number still leads to each one's count. A pair that both directions would find is taken from the first (by the length of the common beginning), so nothing
is found twice and no list of pairs is made: a task hands out how many near words a word has and the most frequent. A half that more than `CROWD` words share is dealt once more,
by the halves of what is left. Forms are followed to the last by pointer doubling; as counts grow tenfold with each step, that takes few rounds.

Texts are read whole: null ones have no word, long ones are read in slices that never cut a run of letters. A null id is hashed as the empty text. Repeated rows count as often as
they occur. Equally frequent near words go by code-point order. Empty tables give no rows. A word of any length is a word: an automaton takes memory in proportion to the code points of its
words. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import few, materialize, pieces, trim

LEAST_LENGTH, LEAST_COUNT, HURT, FACTOR = 7, 2, 31, 10
#: Words that may share a half before they are dealt by further quarters; code points of the words of one automaton (or one group, if that has more).
CROWD, POINTS = 20_000, 200_000
#: Different words that a task counts before it hands them on.
_HELD = 200_000
_SLICE = 1 << 20
#: In Latin-1, where every letter of the runs is one byte; a character that isn't in it becomes `?`.
_BREAK = re.compile(rb"[^A-Za-z\xc0-\xff]")


def _runs(text: str, least: int) -> Iterator[list[bytes]]:
    """The lower-cased runs of at least `least` letters, some at a time."""
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
    data = text.encode("latin-1", "replace")
    at = 0
    while at < len(data):
        cut = _BREAK.search(data, at + _SLICE)
        to = cut.end() if cut else len(data)
        yield run.findall(data[at:to].lower())
        at = to


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, hurt: int = HURT) -> DataFrame:
    """word, n. In a document, a run whose crc32 (of `<id>:<run>`) is a multiple of `hurt` loses the code point at crc32 modulo its length."""

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def go(batches):
        counts: Counter = Counter()
        for b in pieces(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = crc32(f"{'' if i is None else i}:".encode())
                for found in _runs(t or "", least_length):  # a shorter run has no word of that length
                    for run, n in Counter(found).items():
                        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % hurt == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1 :]
                        if len(run) >= least_length:
                            counts[run] += n
            if len(counts) > _HELD:
                yield out(counts)
                counts.clear()
        if counts:
            yield out(counts)
        trim()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(go, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of different words in ascending order. A word's number is its place in that order."""

    def __init__(self, ordered: list[str]):
        arcs: list[dict] = [{}]
        final, known, path, before = [False], {}, [0], ""

        def settle(depth: int) -> None:
            """States below depth on the last word's path get no more arcs: each becomes the known state that accepts the same endings, if there is one."""
            while len(path) - 1 > depth:
                state = path.pop()
                same = known.setdefault((final[state], *arcs[state].items()), state)
                arcs[path[-1]][before[len(path) - 1]] = same
                if same != state:
                    arcs[state] = {}

        for word in ordered:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            settle(same)
            for _ in word[same:]:
                path.append(len(arcs))
                arcs.append({})
                final.append(False)
            final[path[-1]] = True
            before = word
        settle(0)
        # an arc's number is how many words its state accepts before those that go along it
        self.final, self.arcs = final, arcs
        size: dict[int, int] = {}
        stack, ready = [(0, False)], set()
        while stack:
            state, done = stack.pop()
            if state in ready:
                continue
            if not done:
                stack.append((state, True))
                stack.extend((t, False) for t in arcs[state].values() if t not in ready)
                continue
            ready.add(state)
            n = int(final[state])
            for c, t in arcs[state].items():
                arcs[state][c] = (t, n)
                n += size[t]
            size[state] = n
        self.n_states = len(ready)

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        arcs = self.arcs
        for c in text:
            arc = arcs[state].get(c)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """The numbers of words that begin with the first `exact` code points of word and differ from it by one error in the rest."""
        at = self.walk(0, 0, word[:exact])
        out: set[int] = set()
        if at is None:
            return out
        state, number = at
        arcs, final, walk = self.arcs, self.final, self.walk

        def end(at) -> None:
            if at is not None and final[at[0]]:
                out.add(at[1])

        for i in range(exact, len(word) + 1):
            rest, after = word[i:], word[i + 1 :]
            for c, (t, before) in arcs[state].items():
                end(walk(t, number + before, rest))
                if rest and c != rest[0]:
                    end(walk(t, number + before, after))
            if not rest:
                break
            end(walk(state, number, after))
            arc = arcs[state].get(rest[0])
            if arc is None:
                break
            state, number = arc[0], number + arc[1]
        return out


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            return n
        n += 1
    return n


def _head(n: Column) -> Column:
    return F.substring(F.col("word"), F.lit(1), n)


def _tail(n: Column) -> Column:
    return F.substring(F.col("word"), F.greatest(F.length("word") - n, F.lit(0)) + 1, n)


_ALL = (1 << 31) - 1


def _place(back: bool, part: Column, key: tuple, asks: bool | Column, low: Column | int, high: Column | int) -> Column:
    """A word's place in the group of those with its key. If it asks there: for words with its first (back: last) `part` code points and from low to high - 1 first ones in common."""
    asked = {"exact": part, "low": low, "high": high}
    return F.struct(F.xxhash64(*key).alias("key"), F.lit(back).alias("back"), part.cast("int").alias("part"), *(F.when(F.lit(asks), F.lit(c)).cast("int").alias(n) for n, c in asked.items()))


def halves(counted: DataFrame) -> DataFrame:
    """word, n and the places of each word: by the halves that it asks with, and by those with which a word one code point longer or shorter asks for it."""
    size = F.length("word")
    head, odd = F.floor(size / 2), size % 2
    tail = size - head
    out = []
    for asks in (True, False):
        h, t = (head, tail) if asks else (head + 2 * odd - 1, tail + 1 - 2 * odd)
        out.append(_place(False, h, (F.lit("head"), _head(h)), asks, head, _ALL))
        out.append(_place(True, t, (F.lit("tail"), _tail(t)), asks, 0, head))
    return counted.select("word", "n", F.explode(F.array(*out)).alias("at")).select("word", "n", "at.*")


def quarters(rows: DataFrame) -> DataFrame:
    """The rows of crowded groups, dealt by the halves of what their words don't share."""
    size, part, was = F.length("word"), F.col("part"), F.col("exact").isNotNull()
    left = size - part
    near, odd = F.floor(left / 2), left % 2
    far = left - near
    forward, backward = [], []
    for own in (True, False):
        asks = was & F.lit(own)
        n, f = (near, far) if own else (near + 2 * odd - 1, far + 1 - 2 * odd)
        forward.append(_place(False, part + n, (F.lit("head 2"), _head(part + n)), asks, part + near, _ALL))
        forward.append(_place(True, f, (F.lit("head and tail"), _head(part), _tail(f)), asks, part, part + near))
        backward.append(_place(True, part + n, (F.lit("tail 2"), _tail(part + n)), asks, 0, far))
        backward.append(_place(False, f, (F.lit("tail and head"), _tail(part), _head(f)), asks, far, left))
    return rows.select("word", "n", F.explode(F.when(F.col("back"), F.array(*backward)).otherwise(F.array(*forward))).alias("at")).select("word", "n", "at.*")


def _meet(rows: list[tuple]) -> Iterator[tuple]:
    """word, n_near, best_n, best of those that ask among rows (word, n, back, exact, low, high) and have a near word there."""
    for side in (False, True):
        turn = slice(None, None, -1 if side else 1)
        own = [r for r in rows if r[2] == side]
        counts = {r[0][turn]: r[1] for r in own}
        ordered = sorted(counts)
        automaton = Automaton(ordered)
        for word, _, _, exact, low, high in own:
            if exact is None:
                continue
            n_near, best_n, best = 0, 0, ""
            for number in automaton.near(word[turn], exact):
                other = ordered[number]
                n, other = counts[other], other[turn]
                if low <= _common(word, other) < high:
                    n_near += 1
                    if n > best_n or n == best_n and other < best:
                        best_n, best = n, other
            if n_near:
                yield word, n_near, best_n, best


def near_words(counted: DataFrame, crowd: int = CROWD, points: int = POINTS) -> DataFrame:
    """word, n, n_near, best (the most frequent near word), best_n. counted: word, n, written."""
    places = halves(counted)
    crowds = materialize(places.groupBy("key").agg(F.count("*").alias("here")).filter(F.col("here") > crowd).select("key"))
    if not crowds.isEmpty():  # at most one row for each `crowd` places
        hot = few(crowds)
        places = places.join(hot, "key", "left_anti").unionByName(quarters(places.join(hot, "key", "left_semi")))

    def go(batches):
        def found(rows):
            got = list(_meet(rows))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        rows, size, before = [], 0, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("word", "n", "back", "exact", "low", "high")]
            for key, *row in zip(b.column("key").to_pylist(), *columns, strict=True):
                if size > points and key != before:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[0])
                before = key
        if rows:
            yield found(rows)
        trim()

    dealt = places.drop("part").repartition("key").sortWithinPartitions("key")
    got = dealt.mapInArrow(go, "word string, n_near long, best_n long, best string").select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")).alias("best"))
    every = counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: bigint, word: string>").alias("best")).unionByName(got)
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each chain of forms. forms: word, form, written; chains have no circle, as counts grow."""
    while True:
        ahead = forms.select(F.col("word").alias("form"), F.col("form").alias("next"))
        new = materialize(forms.join(ahead, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("word", F.col("form").alias("root"))
        forms = new.drop("moved")


def variants(docs: DataFrame, factor: int = FACTOR, crowd: int = CROWD, points: int = POINTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    found = near_words(materialize(words(docs)), crowd, points)
    own = F.col("best_n") >= factor * F.col("n")
    out = materialize(found.select("word", F.when(own, F.col("best")).alias("form"), "n", "n_near", F.when(own, F.col("best_n")).alias("form_n")))
    last = roots(out.filter("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
