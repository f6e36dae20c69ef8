"""The kernels as functions of a session's SQL, and contour files as table functions.

What has a form in SQL is a SQL function: its body becomes part of the calling plan, so filters are pushed through it and no row leaves the JVM. The warp and the MATLAB
writer are Arrow UDFs. SQL functions can't stand inside a generator: take them in a subquery below posexplode. A null argument gives null, and a file that can't be read a row with its error.

    register(spark)
    spark.sql("SELECT dtw(p.weight, c.freq, 3).similarity FROM contours c JOIN prototypes p ON length_ratio_ok(size(p.weight), size(c.freq), 3)")
    spark.sql("SELECT f.path, c.* FROM files f, LATERAL read_contour(f.path, f.content) c")
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from undula.functions import kernels
from undula.sources import files, mat5

_INF = "double('infinity')"


def _spread(length: str) -> str:
    """SQL of freq at evenly spaced positions, ends kept."""
    at = f"transform(sequence(0, {length} - 1), t -> if({length} = 1, 0D, t * cast(size(freq) - 1 AS double) / ({length} - 1)))"
    left = "greatest(least(cast(floor(at) AS int), size(freq) - 2), 0)"
    return f"transform({at}, at -> get(freq, {left}) + (coalesce(get(freq, {left} + 1), get(freq, {left})) - get(freq, {left})) * (at - {left}))"


_LENGTH = "greatest(1, cast(bround(1 + (size(freq) - 1) / (seconds / tempres)) AS int))"
#: name: parameters, type of the result, body.
SQL = {
    "similarity_matrix": ("a array<double>, b array<double>", "array<array<double>>", "transform(a, x -> transform(b, y -> least(x, y) / if(greatest(x, y) = 0, 1e-10D, greatest(x, y)) * 100))"),
    "length_ratio_ok": ("m int, n int, w int", "boolean", "if(m IS NULL OR n IS NULL, NULL, (m = 1 AND n = 1) OR (least(m, n) > 1 AND greatest(m, n) < w * (least(m, n) - 1)))"),
    "valid_weight": ("weight array<double>", "array<double>", f"filter(weight, x -> x > 0 AND x < {_INF})"),
    "art_match": (
        "contour array<double>, weight array<double>", "double",
        f"""CASE WHEN size(contour) <> size(weight) THEN raise_error('contour and prototype differ in length') ELSE
        aggregate(filter(zip_with(contour, weight, (c, w) -> if(w > 0 AND w < {_INF}, least(c, w) / greatest(c, w), NULL)), x -> x IS NOT NULL),
          named_struct('total', 0D, 'n', 0), (a, x) -> named_struct('total', a.total + x, 'n', a.n + 1), a -> if(a.n = 0, 0D, a.total / a.n * 100)) END""",
    ),
    "warp_gather": ("contour array<double>, warp array<int>", "array<double>", "transform(warp, j -> get(contour, j))"),
    "unwarp": (
        "warp array<int>", "array<int>",
        """if(size(warp) = 0, cast(array() AS array<int>), aggregate(sequence(0, element_at(warp, -1)), cast(array() AS array<int>),
          (found, i) -> concat(found, array(coalesce(cast(nullif(array_position(warp, i), 0) - 1 AS int), get(found, size(found) - 1), 0)))))""",
    ),
    "resample_linear": ("freq array<double>, tempres double, seconds double", "array<double>", f"CASE WHEN tempres <= 0 OR seconds <= 0 THEN raise_error('time steps must be positive') WHEN size(freq) < 2 THEN freq ELSE {_spread(_LENGTH)} END"),
    "cap_length": ("freq array<double>, longest int", "array<double>", f"CASE WHEN longest < 1 THEN raise_error('the longest length must be 1 or more') WHEN size(freq) > longest THEN {_spread('longest')} ELSE freq END"),
    "safe_tempres": ("tempres double, otherwise double", "double", "coalesce(if(tempres > 0, tempres, NULL), otherwise)"),
    "strip_extension": ("name string", "string", "regexp_replace(trim(name), '(?i)[.](ctr|csv|txt)$', '')"),
}
_WARP = pa.struct([("similarity", pa.float64()), ("warp", pa.list_(pa.int32()))])


def _dtw(ref: pa.Array, other: pa.Array, w: pa.Array) -> pa.Array:
    """Pairs of one w at a time, so that they share a table."""
    a, b, ws = ref.to_pylist(), other.to_pylist(), w.to_pylist()
    out: list = [None] * len(a)
    for level in {x for x in ws if x is not None}:
        own = [i for i, x in enumerate(ws) if x == level and a[i] is not None and b[i] is not None]
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            for i, (s, warp) in zip(part, kernels.dtw_pairs([a[i] for i in part], [b[i] for i in part], level), strict=True):
                out[i] = {"similarity": s, "warp": warp}
    return pa.array(out, _WARP)


def _update(contour: pa.Array, weight: pa.Array, rate: pa.Array, warp: pa.Array) -> pa.Array:
    rows = zip(contour.to_pylist(), weight.to_pylist(), rate.to_pylist(), warp.to_pylist(), strict=True)
    return pa.array([None if None in (c, w, r, j) else kernels.update(c, w, r, j) for c, w, r, j in rows], pa.list_(pa.float64()))


def _write_ctr(freq: pa.Array, tempres: pa.Array) -> pa.Array:
    rows = zip(freq.to_pylist(), tempres.to_pylist(), strict=True)
    return pa.array([None if f is None else mat5.write({"fcontour": f} | ({} if t is None else {"tempres": t}), compress=True) for f, t in rows], pa.binary())


_CTR = "freq array<double>, tempres double, ctrlength double, ref_id string, parent_ids array<string>"


def _row(read, *args) -> tuple:
    try:
        got = read(*args)
    except files.UNREADABLE as e:
        return (None,) * 5 + (f"{type(e).__name__}: {e}",)
    return (*(got.get(x.split()[0]) for x in _CTR.split(", ")), None)


class ReadCtr:
    """One row for the content of a CTR file."""

    def eval(self, content: bytes):
        if content is not None:
            yield _row(files.read_ctr, bytes(content))


class ReadContour:
    """One row for a contour file of any format, told by its extension."""

    def eval(self, path: str, content: bytes):
        if path is not None and content is not None:
            stem, ext = posixpath.splitext(posixpath.basename(path))
            kind = ext[1:].lower()
            read = {"csv": files.read_csv, "txt": files.read_txt, "ctr": files.read_ctr}.get(kind)
            yield stem, kind, *(_row(read, bytes(content)) if read else (None,) * 5 + (f"unknown format {kind!r}",))


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names. Doing it again changes nothing."""
    for name, (parameters, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("dtw", F.arrow_udf(_dtw, "struct<similarity double, warp array<int>>"))
    spark.udf.register("update_weights", F.arrow_udf(_update, "array<double>"))
    spark.udf.register("write_ctr", F.arrow_udf(_write_ctr, "binary"))
    spark.udtf.register("read_ctr", F.udtf(ReadCtr, returnType=f"{_CTR}, error string"))
    spark.udtf.register("read_contour", F.udtf(ReadContour, returnType=f"name string, source_format string, {_CTR}, error string"))
    return [*SQL, "dtw", "update_weights", "write_ctr", "read_ctr", "read_contour"]
