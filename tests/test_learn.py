"""Online learning by keyed state against a plain fold of each key in its order of arrival."""

import numpy as np
import pytest

from undula.functions import kernels
from undula.operators.art import Params
from undula.streaming.learn import learn, step

PARAMS = Params(vigilance=93, learning_rate=0.3, bias=0.1, max_categories=6)


def plain(contours, p):
    """One contour and one prototype at a time."""
    weights, out = [], []
    for x in contours:
        if not x:
            out.append((None, 0.0, False))
            continue
        x, tried = np.array(x), []
        for k, w in enumerate(weights):
            s, warp = kernels.dtw(kernels.valid(w), x, p.warp_factor_level)
            tried.append((-(s * (1 - p.bias)), k, warp))
        top, won = 0.0, None
        for _, k, warp in sorted(tried, key=lambda t: t[:2]):
            if len(warp):
                m = kernels.match(x[warp], kernels.valid(weights[k]))
                top = max(top, m)
                if m > p.vigilance:
                    weights[k] = kernels.update(x, weights[k], p.learning_rate, warp)
                    won = (k, m, False)
                    break
        if won is None and len(weights) < p.max_categories:
            weights.append(x)
            won = (len(weights) - 1, 100.0, True)
        out.append(won or (None, top, False))
    return out, weights


def made(seed, n):
    rng = np.random.default_rng(seed)
    base = [rng.random(k) * 200 + 50 for k in (6, 9, 14, 20)]
    return [(base[i % 4] * (1 + rng.normal(0, 0.05, len(base[i % 4])))).tolist() if i % 11 else None if i % 2 else [] for i in range(n)]


def test_step_equals_a_plain_fold():
    contours = [c for c in made(1, 80) if c]
    weights = []
    got = [step(np.array(c), weights, PARAMS) for c in contours]
    want, last = plain(contours, PARAMS)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert all(np.array_equal(a, b) for a, b in zip(weights, last, strict=True))


def test_stream_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = {f"s{k}": made(k, 36) for k in range(3)}
    schema = "source string, seq long, freq array<double>"

    def run(lo: int, hi: int):
        rows = [(k, i, c) for k, cs in keys.items() for i, c in list(enumerate(cs))[lo:hi]]
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = learn(stream, PARAMS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run(0, 15)
    run(15, 36)  # another query on the same checkpoint goes on with its prototypes
    got = {(r.source, r.seq): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 3 * 36
    for k, cs in keys.items():
        want, _ = plain(cs, PARAMS)
        assert [got[k, i].category for i in range(36)] == [w[0] for w in want]
        assert [got[k, i].match for i in range(36)] == pytest.approx([w[1] for w in want])
        assert [got[k, i].is_new for i in range(36)] == [w[2] for w in want]
