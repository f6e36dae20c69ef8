"""Toxicity by compression distance: windows are compressed with a dictionary trained on toxic and one trained on ordinary text, and their lengths compared.

A window is one lower-cased word with a space on either side. Labelled texts mark whole documents, so the toxic dictionary is trained on the windows of toxic
texts that are telling, cut to what tells: the window or a beginning of it occurs in significantly more toxic than ordinary texts (log-likelihood ratio above
the logarithm of the number of candidates). The ordinary dictionary is trained on the other windows of ordinary texts. Both get the same carrier bytes, and a window is compressed
between these, so that blocks are never too short to be compressed. The gain of a window is its length under the ordinary dictionary less its length under
the toxic one. A text's score is a logistic function, fitted on labelled texts kept apart from the dictionaries, of how many distinct windows reach each of a
few gains.

So the toxic dictionary holds what a test of single words tells about toxic texts; toxicity that only combinations of ordinary words carry is not scored, and
without a telling window every text gets the prior. At most `toxic` + `ordinary` labelled rows are sampled, in the order of a hash of their id; near copies among them count once. Every window of every text is
scored. Null and empty texts have no window and get the score of none. If either class has no sample every score is the prior (0 without labels). A document
labelled more than once counts as toxic if any row says so; repeated rows are scored alike; columns other than doc_id and text are never looked at.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import crc_mod, map_arrow, texts_of

#: Labelled rows that are fitted on, at most.
TOXIC, ORDINARY = 3000, 5000
#: Windows of ordinary texts that the ordinary dictionary is trained on, at most.
PLAIN = 400_000
#: Bytes of the dictionaries.
TOXIC_BYTES, ORDINARY_BYTES = 4096, 65536
#: Gains, in bytes, that windows are counted at; their weights are calibrated.
STEPS = (3, 4, 5, 6, 7, 8)
#: Fixed bytes around each window, part of both dictionaries.
BEFORE, AFTER = bytes(range(33, 65)), bytes(range(91, 97)) + bytes(range(123, 127)) + bytes(range(1, 9)) + bytes(range(14, 28))
#: Entries of a worker's table of windows; it is emptied when full.
CACHE = 400_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and _WORD[b] else b if _WORD[b] else 32 for b in range(256))


def windows(text: str) -> list[bytes]:
    """The words of a text, lower-cased, signs taken for spaces."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def beginnings(window: bytes):
    """What may be telling of a window: beginnings of 3 to 10 bytes, and all of it."""
    for k in range(3, min(len(window), 11)):
        yield window[:k]
    yield window + b" "


def _once(rows: list[str]) -> list[list[bytes]]:
    """The texts' windows, without texts of whose shingles half were seen in texts before."""
    seen: set[int] = set()
    out = []
    for text in rows:
        w = windows(text)
        marks = sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:8]
        if sum(m in seen for m in marks) * 2 < len(marks):
            seen.update(marks)
            out.append(w)
    return out


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> dict[bytes, bytes]:
    """Beginnings (and whole windows, with a space behind) that mark toxic texts, each with the longest one that stands for its shortest."""
    counts = []
    for texts in (toxic, ordinary):
        c: Counter = Counter()
        for w in texts:
            c.update({b for x in set(w) for b in beginnings(x)})
        counts.append(c)
    a, b = counts
    n, m = len(toxic), len(ordinary)

    def ratio(x: int, y: int) -> float:
        p = (x + y) / (n + m)
        f = lambda k, size, q: (k * math.log(q) if k else 0.0) + ((size - k) * math.log(1 - q) if size > k else 0.0)
        return f(x, n, x / n) + f(y, m, y / m) - f(x, n, p) - f(y, m, p)

    least = math.log(len(a) + 1) + 2
    marks = {t for t, x in a.items() if x >= 3 and x / n > 8 * b[t] / m and ratio(x, b[t]) > least}
    out = {}
    for t in marks:
        short = next((t[:k] for k in range(3, len(t)) if t[:k] in marks), t)
        out[t] = max((u for u in (*(t[:k] for k in range(len(short), len(t))), t) if a[u] >= 0.8 * a[short]), key=len)
    return out


def _train(items: list[bytes], size: int) -> bytes:
    samples = [b" " + b" ".join(items[i : i + 8]) + b" " for i in range(0, len(items), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-size:]


def _shuffled(items: list[bytes], seed: int) -> list[bytes]:
    return [items[i] for i in np.random.default_rng(seed).permutation(len(items))]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def open(self) -> None:
        settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, write_content_size=False, write_dict_id=False, write_checksum=False)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self._a, self._b = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(BEFORE + AFTER + d, dict_type=kind), compression_params=settings) for d in (self.toxic, self.ordinary))
        self._gains: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves against the ordinary one."""
        g = self._gains.get(window)
        if g is None:
            w = BEFORE + b" " + window + b" " + AFTER
            g = len(self._b.compress(w)) - len(self._a.compress(w))
            if len(self._gains) >= CACHE:
                self._gains.clear()
            self._gains[window] = g
        return g

    def inputs(self, w: list[bytes]) -> tuple[float, ...]:
        """1, then for each threshold the logarithm of how many distinct windows reach it, and their number against the square root of all."""
        gains = [self.gain(x) for x in set(w)]
        n = [sum(g >= t for g in gains) for t in STEPS]
        return 1.0, *map(math.log1p, n), *(x / math.sqrt(len(gains) + 1) for x in n)

    def score(self, w: list[bytes]) -> float:
        if not self.weights:
            return self.prior
        z = sum(a * b for a, b in zip(self.weights, self.inputs(w), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from sampled texts: two thirds make the dictionaries, a third calibrates."""
    tox, ord_ = _once(toxic), _once(ordinary)
    if len(tox) < 3 or len(ord_) < 3:
        return Model(b"", b"", prior=len(toxic) / max(1, len(toxic) + len(ordinary)))
    a, b = ([w for i, w in enumerate(t) if i % 3] for t in (tox, ord_))
    marks = telling(a, b)
    counts = Counter(w for t in a for w in t)
    stems = {w: max((marks[x] for x in beginnings(w) if x in marks), key=len, default=None) for w in counts}
    told = [x for w, s in stems.items() if s for x in (w, s.strip()) for _ in range(min(counts[w], 20))]
    if not told:
        return Model(b"", b"", prior=len(toxic) / (len(toxic) + len(ordinary)))
    told = _shuffled(told * (1 + 2000 // len(told)), 1)
    plain = _shuffled([w for t in b for w in t if not any(x in marks for x in beginnings(w))], 2)[:PLAIN]
    model = Model(_train(told, TOXIC_BYTES), _train(plain, ORDINARY_BYTES))
    model.open()
    held = [w for i, w in enumerate(tox) if not i % 3], [w for i, w in enumerate(ord_) if not i % 3]
    x = np.array([model.inputs(w) for t in held for w in t])
    y = np.concatenate([np.full(len(t), float(k)) for t, k in zip(held, (1, 0), strict=True)])
    model.weights = tuple(_logistic(x, y))
    return Model(model.toxic, model.ordinary, model.weights)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """A model from at most `toxic` + `ordinary` rows of labels (doc_id, toxic) and the texts of docs."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(ordinary))
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id").filter("text is not null").dropDuplicates(["doc_id"])  # ids are bounded by the sample
    found = sorted((r.doc_id, r.toxic, r.text) for r in rows.toLocalIterator())
    return fit([t for _, x, t in found if x], [t for _, x, t in found if not x])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, and score (0 to 1)."""
    rows = texts_of(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("doc_id", *keep))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if not hasattr(m, "_gains"):
            m.open()
        out = [m.score(windows(t or "")) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(out, pa.float64())], names=["doc_id", *keep, "score"])

    return map_arrow(rows, run, f"{kinds}, score double")


def trained_apart(labels: DataFrame) -> DataFrame:
    """The labels that a held-out test may learn from: crc32 of doc_id modulo 3 is not 1."""
    return labels.filter(crc_mod("doc_id", 3) != 1)
