"""Packing of token sequences by non-negative least squares over shallow length combinations.

A document of n tokens is cut into full windows, one body (a multiple of `unit` tokens, shorter than a window) and one crumb (under `unit` tokens).
Full windows are sequences by themselves. Crumbs fill windows of their own partition one after the other. Bodies are packed by a plan: all combinations of
up to `depth` lengths that fill a window are enumerated, the repeat counts that best match the histogram of body lengths are solved for with x >= 0, rounded
down to what the histogram holds, and each body takes the place of its rank among the bodies of its length. Bodies beyond the plan are packed greedily:
each is cut at powers of two, largest first, and the parts of each size fill windows together. A last window that would stay short is cut into sequences
whose lengths are powers of two, which need no padding, so no sequence is padded at all.

The histogram has window / unit rows at any input size; ranks come from counters within a task plus a prefix sum over tasks, so no length is gathered in one
place. Null text is an empty document (its end token is still packed). Rows with one doc_id, or with null for one, are documents of their own. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.bpe import ByteEncoder, encoder
from undula.llm.common import materialize, pieces, small_batches, texts_of, trim

WINDOW, UNIT, DEPTH = 2048, 32, 3
END_ID = 1
#: Sequence ids made within tasks start here; planned ones start at 0.
LOCAL = 1 << 62
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ITEM = _OUT + ", units int, part int, rank long, parts array<long>"
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "units", "part", "rank", "parts"]
_SCHEMA = pa.schema([*((f, pa.int64()) for f in _FIELDS[:7]), ("units", pa.int32()), ("part", pa.int32()), ("rank", pa.int64()), ("parts", pa.list_(pa.int64()))])


def powers_of_two(n: int) -> list[int]:
    """The powers of two that n is made of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Cutter:
    """Cuts one task's documents; holds the crumbs of one open window at most."""

    def __init__(self, task: int, window: int, unit: int):
        self.window, self.unit, self.task = window, unit, task
        self.next = LOCAL + (task << 36)
        self.open: list[tuple[int | None, int, bytes, int]] = []
        self.size = 0
        self.ranks = [0] * (window // unit)
        self.rows: list[tuple] = []

    def final(self, doc, start, ids, total, seq, offset):
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, None, None, None, None))

    def add(self, doc: int | None, ids: bytes) -> None:
        n, w, u = len(ids) // 4, self.window, self.unit
        full = n // w * w
        for at in range(0, full, w):
            self.final(doc, at, ids[4 * at : 4 * (at + w)], n, self.next, 0)
            self.next += 1
        units = (n - full) // u
        if units:
            end = full + units * u
            parts, at = [], full
            for p in powers_of_two(units):
                parts.append(zlib.crc32(ids[4 * at : 4 * (at + p * u)]))
                at += p * u
            self.rows.append((doc, full, units * u, zlib.crc32(ids[4 * full : 4 * end]), n, None, None, units, self.task, self.ranks[units], parts))
            self.ranks[units] += 1
            full = end
        if full < n:
            self.open.append((doc, full, ids[4 * full :], n))
            self.size += n - full
            if self.size >= w:
                self.flush(w)

    def flush(self, length: int) -> None:
        """The first `length` tokens of the open crumbs become a sequence."""
        at = 0
        while at < length:
            doc, start, ids, n = self.open[0]
            k = min(len(ids) // 4, length - at)
            self.final(doc, start, ids[: 4 * k], n, self.next, at)
            at += k
            self.open[0] = (doc, start + k, ids[4 * k :], n)
            if not self.open[0][2]:
                self.open.pop(0)
        self.size -= length
        self.next += 1

    def close(self) -> None:
        for p in powers_of_two(self.size):
            self.flush(p)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[] for _ in _FIELDS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def cut(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT, lasting: bool = True) -> DataFrame:
    """Pieces that are placed (sequence_id set), and bodies that wait for the plan (units, part, rank, parts set)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path, ByteEncoder)
        cutter = _Cutter(TaskContext.get().partitionId(), window, unit)
        for batch in pieces(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cutter.add(doc, enc.encode_text(text or "") + end)
            yield cutter.take()
        cutter.close()
        yield cutter.take()
        enc.forget()
        if not lasting:
            del enc
            encoder.cache_clear()
        trim()

    return texts_of(docs).mapInArrow(run, _ITEM)


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to `depth` positive numbers that sum to total, each under total."""
    out = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(most, left), 0, -1):
                if x * (depth - len(head)) >= left:
                    grow((*head, x), left - x, x)

    grow((), total, total - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b| with x >= 0, by an active set: add the steepest column, solve, step back to the border where a count would turn negative."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    gram, rhs = a.T @ a, a.T @ b
    floor = 1e-9 * max(1.0, np.abs(rhs).max(initial=0))
    for _ in range(rounds):
        slope = rhs - gram @ x
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= floor:
            break
        used[j] = True
        while True:
            on = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 1e-12
            ratio = x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)
            step = ratio.min(initial=1.0)
            x[on] += step * (z - x[on])
            used[on[(x[on] <= 1e-12) & low]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


@dataclass
class Plan:
    """Where the bodies of each length go. places: (units, first rank, end rank, first sequence, copies, offset in units). left: bodies of each length past
    the plan. whole: places of the parts of each power of two."""

    places: list[tuple[int, int, int, int, int, int]]
    taken: list[int]
    left: list[int]
    sequences: int
    units: int

    def parts(self) -> tuple[dict, dict, int]:
        """For each size: its first full sequence and how many parts fill full ones; then the places of the last parts (size, index) -> (sequence, offset)."""
        number = {1 << b: sum(n for u, n in enumerate(self.left) if u >> b & 1) for b in range(self.units.bit_length() - 1)}
        at, full, rest = self.sequences, {}, []
        for size, n in number.items():
            per = self.units // size
            full[size] = (at, n // per * per)
            at += n // per
            rest += [(size, i) for i in range(n // per * per, n)]
        rest.sort(key=lambda x: (-x[0], x[1]))
        total, last, i = sum(s for s, _ in rest), {}, 0
        for length in [self.units] * (total // self.units) + powers_of_two(total % self.units):
            offset = 0
            while offset < length:
                last[rest[i]] = (at, offset)
                offset += rest[i][0]
                i += 1
            at += 1
        return full, last, at


def plan(histogram: dict[int, int], units: int = WINDOW // UNIT, depth: int = DEPTH) -> Plan:
    """The plan for bodies of 1 .. units-1 units, from their counts."""
    h = np.zeros(units)
    for u, n in histogram.items():
        h[u] = n
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, c in enumerate(combos):
        for u in c:
            a[u, j] += 1
    weight = np.arange(units) / units + 0.1  # tokens left over count more than pieces left over
    x = nnls(a * weight[:, None], h * weight) if h.any() else np.zeros(len(combos))
    left = [histogram.get(u, 0) for u in range(units)]
    counts = [0] * len(combos)
    for j in [*np.argsort(-x, kind="stable"), *sorted(range(len(combos)), key=lambda j: (len(combos[j]), j))]:
        need = {u: combos[j].count(u) for u in combos[j]}
        wanted = round(float(x[j])) if not counts[j] else 0
        most = min(left[u] // k for u, k in need.items())
        k = min(wanted, most) if x[j] > 0 and not counts[j] else most
        counts[j] += k
        for u, c in need.items():
            left[u] -= c * k
    for j in range(len(combos)):  # what rounding has left
        need = {u: combos[j].count(u) for u in combos[j]}
        k = min(left[u] // c for u, c in need.items())
        counts[j] += k
        for u, c in need.items():
            left[u] -= c * k
    at, first, places = 0, [0] * units, []
    for j, n in enumerate(counts):
        if n:
            offset = 0
            for u in sorted(set(combos[j]), reverse=True):
                c = combos[j].count(u)
                places.append((u, first[u], first[u] + n * c, at, c, offset))
                first[u] += n * c
                offset += u * c
            at += n
    return Plan(places, first, left, at, units)


def place(items: DataFrame, p: Plan, unit: int = UNIT) -> DataFrame:
    """The bodies' final pieces; items has units, rank (over all tasks) and the columns of cut()."""
    by_units: dict[int, list] = {}
    for row in p.places:
        by_units.setdefault(row[0], []).append(row[1:])
    full, last, _ = p.parts()
    taken, left = p.taken, p.left
    before = {(u, 1 << b): sum(n for v, n in enumerate(left[:u]) if v >> b & 1) for u in range(p.units) for b in range(p.units.bit_length())}
    units_of = p.units

    def run(batches):
        for batch in batches:
            rows = []
            for doc, start, length, crc, total, u, rank, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "rank", "parts")), strict=True):
                if rank < taken[u]:
                    for lo, hi, seq, copies, offset in by_units[u]:
                        if lo <= rank < hi:
                            k, i = divmod(rank - lo, copies)
                            rows.append((doc, start, length, crc, total, seq + k, (offset + i * u) * unit))
                            break
                    continue
                for size, c in zip(powers_of_two(u), parts, strict=True):
                    i = before[u, size] + rank - taken[u]
                    seq, whole = full[size]
                    if i < whole:
                        k, j = divmod(i, units_of // size)
                        seq, offset = seq + k, j * size
                    else:
                        seq, offset = last[size, i]
                    rows.append((doc, start, size * unit, c, total, seq, offset * unit))
                    start += size * unit
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_FIELDS[:7])

    return items.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "rank", "parts").mapInArrow(run, _OUT)


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, lasting: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. lasting: workers keep the loaded encoder (about 75 MB) for their next tasks."""
    with small_batches(docs.sparkSession):
        items = materialize(cut(docs, path, end_id, window, unit, lasting))
    bodies = items.filter(F.col("units").isNotNull())
    counts = bodies.groupBy("units", "part").agg(F.count("*").alias("n"))
    # a row for each task and length, so this window holds as many rows as there are tasks
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r.units: r.n for r in bodies.groupBy("units").agg(F.count("*").alias("n")).collect()}
    ranked = bodies.join(first.select("units", "part", "first"), ["units", "part"]).withColumn("rank", F.col("rank") + F.coalesce("first", F.lit(0)))
    placed = place(ranked, plan(histogram, window // unit, depth), unit)
    return items.filter(F.col("units").isNull()).select(*_FIELDS[:7]).unionByName(placed)
