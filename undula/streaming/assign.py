"""Assignment of contours as they arrive: an extension, the same kernels as the batch operator in a Structured Streaming query without state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from undula.functions import kernels

#: Prototypes that are sent to the tasks at most; a model has max_categories of them.
MOST = 20_000


def assign(stream: DataFrame, prototypes: DataFrame, vigilance: float = 85.0, bias: float = 0.0, w: int = 3) -> DataFrame:
    """contour_id, category, match of a streaming (or batch) frame of contour_id, freq. Only the best prototype is tried, ties by the smaller category."""
    rows = sorted((r.category, r.weight) for r in prototypes.limit(MOST + 1).collect())
    if not rows:
        raise RuntimeError("there is no prototype: train first")
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} prototypes")
    names, weights = [c for c, _ in rows], [kernels.valid(x) for _, x in rows]

    def run(batches):
        for batch in batches:
            out = []
            for freq in batch.column("freq").to_pylist():
                found = kernels.dtw_pairs(weights, [freq] * len(weights), w)
                k = max(range(len(found)), key=lambda i: (found[i][0] * (1 - bias), -i))
                warp = found[k][1]
                m = kernels.match([freq[j] for j in warp], weights[k]) if len(warp) else 0.0
                out.append((names[k] if m > vigilance else None, m))
            category, match = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("contour_id"), pa.array(category, pa.int32()), pa.array(match, pa.float64())], names=["contour_id", "category", "match"])

    return stream.select("contour_id", "freq").mapInArrow(run, "contour_id long, category int, match double")
