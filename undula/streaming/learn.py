"""Categories learnt online, a stream's keys apart: an extension, the training step with the order of arrival in place of permutations.

Prototypes are keyed state, one entry a category, so a step writes only the prototype that it moved; a key's state is bounded by max_categories. The state store keeps them over
restarts and lost executors. Needs the RocksDB provider: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from undula.functions import kernels
from undula.operators.art import Params


def step(contour: np.ndarray, weights: list[np.ndarray], p: Params) -> tuple[int | None, float, bool]:
    """The category of a contour that arrives (null if there is none and no room for one), its match, and whether the category is new. weights is changed as the contour is learnt."""
    found = kernels.dtw_pairs([kernels.valid(w) for w in weights], [contour] * len(weights), p.warp_factor_level)
    top = 0.0
    for k in sorted(range(len(weights)), key=lambda k: (-found[k][0] * (1 - p.bias), k)):
        warp = found[k][1]
        if not len(warp):
            continue
        m = kernels.match(contour[warp], kernels.valid(weights[k]))
        top = max(top, m)
        if m > p.vigilance:
            weights[k] = kernels.update(contour, weights[k], p.learning_rate, warp, p.compare_warped)
            return k, m, False
    if len(weights) < p.max_categories:
        weights.append(contour.copy())
        return len(weights) - 1, 100.0, True
    return None, top, False


class _Learner(StatefulProcessor):
    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prototypes = handle.getMapState("prototypes", StructType([StructField("category", IntegerType())]), StructType([StructField("weight", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A batch's contours in their order of arrival (column seq); the state is read once and written where it changed."""
        stored = {int(k[0]): np.frombuffer(v[0], dtype=np.float64) for k, v in self.prototypes.iterator()} if self.prototypes.exists() else {}
        weights = [stored[k] for k in range(len(stored))]
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out, moved = [], set()
        for seq, freq in zip(batch["seq"], batch["freq"], strict=True):
            contour = np.zeros(0) if freq is None else np.asarray(freq, dtype=np.float64)
            category, match, new = step(contour, weights, self.params) if len(contour) else (None, 0.0, False)
            if category is not None:
                moved.add(category)
            out.append((key[0], seq, category, match, new))
        for k in moved:
            self.prototypes.updateValue((k,), (weights[k].tobytes(),))
        yield pd.DataFrame(out, columns=["source", "seq", "category", "match", "is_new"]).astype({"category": "Int32"})

    def close(self) -> None:
        pass


def learn(stream: DataFrame, params: Params | None = None) -> DataFrame:
    """source, seq, category, match, is_new of a stream of source (string), seq (long, the order within a batch), freq (array<double>).

    Null and empty contours get no category and teach nothing. Only vigilance, learning_rate, bias, max_categories, warp_factor_level and compare_warped of params are used.
    """
    rows = stream.select("source", "seq", "freq")
    return rows.groupBy("source").transformWithStateInPandas(_Learner(params or Params()), "source string, seq long, category int, match double, is_new boolean", "append", "none")
