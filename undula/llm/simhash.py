"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its word shingles. Two fingerprints link at `radius` or fewer differing bits.
By the triangle inequality the distances of linked fingerprints to any reference fingerprint differ by at most the radius, so a table of distances to many
references discards pairs by their largest coordinate difference; survivors are verified bit by bit.

The table alone looks at every pair, so pairs come from blocks: the 64 bits are cut into radius + k blocks, and two linked fingerprints agree on k of them at
least. Every choice of k blocks is a key; k grows with the number of fingerprints so that keys stay rare. Keys of many fingerprints are cut again by the
remaining bits. Within a key only a spanning forest of the links leaves the task, never all pairs. Equal fingerprints are one row (with the smallest doc_id
and their number) before any of this, so copies cost nothing.

Null and empty texts have no word: fingerprint zero, linked like any other. Null ids never represent a group and get its component like all others; a
component without an id is null. Rows with one doc_id are judged each by its own text and are one node. Only doc_id and text are read.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import few, map_arrow, materialize, texts_of, trim
from undula.llm.components import components, forest

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Reference fingerprints of the distance table.
PIVOTS = 32
#: Fingerprints that one key (two blocks at least) may hold on average before another block is added, and at most before it is cut again.
DENSE, CROWDED = 32, 1024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    values = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        bits += np.unpackbits(values[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns in keep, and fp (the fingerprint's bits as a signed long)."""
    rows = texts_of(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("doc_id", *keep))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or b"", shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(fp.view(np.int64))], names=["doc_id", *keep, "fp"])

    return map_arrow(rows, run, f"{kinds}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, by a fixed rule: the XXH64 values of 0 .. n-1."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], dtype=np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row per fingerprint and a column per reference."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def tiles(fp: np.ndarray, radius: int, refs: np.ndarray):
    """Index pairs of fingerprints within the radius, from about a million compared at a time: sorted by the first coordinate, discarded coordinate by
    coordinate, then verified."""
    table = distance_table(fp, refs)
    order = np.argsort(table[:, 0], kind="stable")
    table, own = table[order], fp[order]
    last = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    n = last - np.arange(len(fp)) - 1
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), side="right")) - 1)
        k = n[at:to]
        i = np.repeat(np.arange(at, min(to, len(fp))), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        for c in range(1, table.shape[1]):
            if not len(i):
                break
            keep = np.abs(table[i, c] - table[j, c]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(own[i] ^ own[j]) <= radius
        if keep.any():
            yield order[i[keep]], order[j[keep]]
        at = to


def pairs_within(fp: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of fingerprints within the radius."""
    out = list(tiles(fp, radius, refs)) or [(np.zeros(0, int), np.zeros(0, int))]
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def connect(fp: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what all pairs within the radius connect; never many more of them than fingerprints are held."""
    a = b = np.zeros(0, dtype=np.int64)
    for i, j in tiles(fp, radius, refs):
        a, b = np.concatenate([a, i]), np.concatenate([b, j])
        if len(a) > len(fp):
            node, root = forest(a, b)
            a, b = root[node != root], node[node != root]
    return a, b


def masks(blocks: int, keep: int, bits: list[int] | None = None) -> list[int]:
    """A mask for each choice of `keep` blocks of the bits."""
    bits = list(range(64)) if bits is None else bits
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for i in c for b in cut[i]) for c in combinations(range(blocks), keep)]


def split(fp: np.ndarray, radius: int, used: int) -> list[tuple[np.ndarray, int]] | None:
    """Rows that agree on two more blocks, with all bits on which they now agree; None if that doesn't cut a crowd into parts of an eighth at most."""
    free = [b for b in range(64) if not used >> b & 1]
    if len(fp) <= CROWDED or len(free) < radius + 2:
        return None
    out = []
    for m in masks(radius + 2, 2, free):
        key = fp & np.uint64(m)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        size = np.diff(edge)
        if size.max() * 8 > len(fp):
            return None
        out += [(order[a : a + n], used | m) for a, n in zip(edge[:-1][size > 1], size[size > 1], strict=True)]
    return out


def links(fp: np.ndarray, radius: int, refs: np.ndarray, used: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A set of index pairs within the radius that connects what all such pairs connect. used: bits on which all of fp agree.

    A crowd is cut by further blocks where these cut it well; else its pairs are discarded by the distance table a million at a time.
    """
    parts = split(fp, radius, used)
    if parts is None:
        return connect(fp, radius, refs)
    out_i, out_j = [], []
    for own, agreed in parts:
        i, j = links(fp[own], radius, refs, agreed)
        if len(i) >= len(own):
            node, root = forest(i, j)
            i, j = root[node != root], node[node != root]
        out_i.append(own[i])
        out_j.append(own[j])
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


#: Keys of up to so many rows are compared by shifts of the whole sorted batch, larger ones one by one.
SMALL_KEY = 32


def new_pairs(diff: np.ndarray, mask: np.ndarray, masks_: list[int]) -> np.ndarray:
    """Which pairs that differ by `diff` and share the key of a mask (its number) share no key of an earlier mask."""
    fresh = np.ones(len(diff), dtype=bool)
    for i, m in enumerate(masks_):
        fresh &= (mask <= i) | ((diff & np.uint64(m)) != 0)
    return fresh


def _stars(radius: int, masks_: list[int]):
    """Rows (key, fp, node) sorted by key -> edges (a, b); a key's rows are held together, other keys' go by."""

    def run(batches):
        refs = pivots()
        held = [np.zeros(0, np.int64)] * 3

        def edges(key, fp, node):
            """All keys of the arrays, sorted; single rows are skipped."""
            if not len(key):
                return None
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            a, b = [], []
            few_rows = np.repeat((size > 1) & (size <= SMALL_KEY), size)
            own = np.flatnonzero(few_rows)
            k, f, n = key[own], fp[own].view(np.uint64), node[own]
            table = distance_table(f, refs[:4])
            for shift in range(1, SMALL_KEY):
                same = np.flatnonzero(k[shift:] == k[:-shift]) if len(k) > shift else np.zeros(0, int)
                if not len(same):
                    break
                same = same[np.abs(table[same] - table[same + shift]).max(axis=1) <= radius]  # discarded by the largest coordinate difference
                diff = f[same] ^ f[same + shift]
                near_ = np.bitwise_count(diff) <= radius
                near_[near_] = new_pairs(diff[near_], k[same[near_]] >> 40, masks_)
                a.append(n[same[near_]])
                b.append(n[same[near_] + shift])
            for s, n_rows in zip(edge[:-1][size > SMALL_KEY], size[size > SMALL_KEY], strict=True):
                mine = node[s : s + n_rows]
                i, j = links(fp[s : s + n_rows].view(np.uint64), radius, refs, masks_[int(key[s]) >> 40] if n_rows > CROWDED else 0)
                if len(i) >= n_rows:
                    x, root = forest(mine[i], mine[j])
                    a.append(root[x != root])
                    b.append(x[x != root])
                else:
                    a.append(mine[i])
                    b.append(mine[j])
            if not a:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "fp", "node"), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            out = edges(*(h[:last] for h in held))
            held = [h[last:] for h in held]
            if out is not None:
                yield out
        out = edges(*held)
        if out is not None:
            yield out
        trim()

    return run


def squeeze(fp: np.ndarray, mask: int) -> np.ndarray:
    """The masked bits, gathered at the low end."""
    out = np.zeros(len(fp), dtype=np.uint64)
    n = 0
    b = 0
    while b < 64:
        if mask >> b & 1:
            k = b
            while k < 64 and mask >> k & 1:
                k += 1
            out |= ((fp >> np.uint64(b)) & np.uint64((1 << (k - b)) - 1)) << np.uint64(n)
            n += k - b
            b = k
        else:
            b += 1
    return out


def near(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between nodes of prints (fp long distinct, node long distinct) whose links connect exactly what all links within the radius connect."""
    n = prints.count()
    keep = 2
    while keep < 4 and n >> min(64 * keep // (radius + keep), 62) > dense:
        keep += 1
    all_masks = masks(radius + keep, keep)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for i, m in enumerate(all_masks):
                # the mask's number above 40 bits; a mask has 32 bits at most
                key = (squeeze(fp.view(np.uint64), m) & np.uint64((1 << 40) - 1)) | np.uint64(i << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp), pa.array(node)], names=["key", "fp", "node"])

    keyed = prints.select("fp", "node").mapInArrow(run, "key long, fp long, node long").repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(_stars(radius, all_masks), "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component: prints (doc_id, fp) by fingerprint, with the smallest doc_id that links reach."""
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # fingerprints are the nodes, so ids may repeat or be null
    found = components(near(own.select("fp", F.col("fp").alias("node")), radius))
    labelled = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("low").alias("id"))
    return labelled.join(least, "component").select("fp", F.col("id").alias("component"))


def assign(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component of every row."""
    prints = materialize(fingerprints(docs, shingle=shingle))
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component")


def survivors(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, whole, that stand for their component: the smallest doc_id (null last), of rows that share it the smallest hash of the text, once."""
    key = [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_row")]
    marked = docs.select("*", *key)
    prints = materialize(fingerprints(marked.select("doc_id", "text", "_row"), "_row", shingle=shingle))
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(near(own.select("fp", F.col("fp").alias("node")), radius))
    group = materialize(own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))
    return stand_for(docs, marked, prints, group)


def stand_for(docs: DataFrame, marked: DataFrame, prints: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component. marked: docs with _doc and _row; prints: doc_id, _row, fp; group: fp, component."""
    rows = prints.groupBy("fp", "doc_id", "_row").agg(F.count("*").alias("n")).join(group, "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    rows = materialize(rows.withColumn("order", order).select("component", "order", "n"))
    first = rows.groupBy("component").agg(F.min("order").alias("first"))
    judged = rows.join(first, "component").select(F.col("order.doc_id").alias("_doc"), F.col("order._row").alias("_row"), (F.col("order") == F.col("first")).alias("stays"), "n")
    gone = materialize(judged.filter("not stays").select("_doc", "_row"))
    twice = materialize(judged.filter("stays and n > 1").select("_doc", "_row"))
    same = lambda b: (marked["_doc"].eqNullSafe(b["_doc"])) & (marked["_row"] == b["_row"])
    kept = marked.join(g := few(gone), same(g), "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    t = few(twice)
    on = (kept["_doc"].eqNullSafe(t["_doc"])) & (kept["_row"] == t["_row"])
    return kept.join(t, on, "left_anti").unionByName(kept.join(t, on, "left_semi").dropDuplicates(["_doc", "_row"])).select(*docs.columns)


def hex_of(fp):
    """The 16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: What shingles are made of, for reference: runs of other than the six white-space bytes.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
