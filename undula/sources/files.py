"""Contour files: CSV, tab-separated text, CTR and saved MATLAB categorisations, parsed one file per row in Arrow batches.

A directory becomes rows of contours(contour_id, name, freq, tempres, ctrlength, ref_id, parent_ids, source_format, path). Files are listed and read by Spark, so any
store that it knows will do. contour_id is dense, by format, then path. A file that can't be read is left out with its error in `failed`.
"""

from __future__ import annotations

import csv
import io
import math
import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators.ordering import numbered
from undula.sources import mat5
from undula.storage import materialize

FORMATS = ("ctr", "csv", "txt")
#: What a file that isn't what it should be may raise.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, AttributeError)
PARSED = "name string, freq array<double>, tempres double, ctrlength double, ref_id string, parent_ids array<string>, source_format string, path string, error string"
_FIELDS = [x.split()[0] for x in PARSED.split(", ")]
_TYPES = [pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]


def frequency_column(header: list[str]) -> int | None:
    """The first column that speaks of a frequency."""
    return next((i for i, h in enumerate(header) if any(x in h.strip().lower() for x in ("frequency", "hz"))), None)


def time_column(header: list[str]) -> int | None:
    """The first column that speaks of a time in ms or seconds."""
    for i, h in enumerate(header):
        low = h.strip().lower()
        if low == "time" or "time" in low and any(x in low for x in ("ms", "sec", "s]")):
            return i
    return None


def step_of(times: list[float], ms: bool) -> float:
    """Seconds per point."""
    return abs(times[-1] - times[0]) / (1000 if ms else 1) / (len(times) - 1) if len(times) > 1 else 0.0


def _number(text: str) -> float:
    return float(text) if text.strip() else math.nan


def read_csv(content: bytes, column: int = 0, skip: int = 1) -> dict:
    """A CSV with a frequency header, and a time column perhaps; without such a header, the column asked for below `skip` rows."""
    rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if r]
    if not rows:
        raise ValueError("the file is empty")
    f = frequency_column(rows[0])
    if f is not None:
        freq = [_number(r[f]) for r in rows[1:]]
        t = time_column(rows[0])
        tempres = step_of([_number(r[t]) for r in rows[1:]], "ms" in rows[0][t].lower()) if t is not None and rows[1:] else None
        return {"freq": freq, "tempres": tempres, "ctrlength": None}
    rows = rows[skip:]
    if rows and column >= len(rows[0]):
        raise ValueError(f"column {column} not found")
    return {"freq": [_number(r[column]) for r in rows], "tempres": None, "ctrlength": None}


def read_txt(content: bytes, column: int = 0, delimiter: str = "\t") -> dict:
    """A table without header: the last value is dropped; the last that stays, in thousandths, is taken for the length in seconds, as the format has it."""
    rows = [line.split(delimiter) for line in content.decode("utf-8-sig").splitlines() if line.strip()]
    if not rows:
        raise ValueError("the file is empty")
    if column >= len(rows[0]):
        raise ValueError(f"column {column} not found")
    freq = [_number(r[column]) for r in rows]
    freq = freq[:-1] if len(freq) > 1 else freq
    length = freq[-1] / 1000
    return {"freq": freq, "tempres": length / len(freq), "ctrlength": length}


def _texts(value) -> list[str]:
    return [str(v).strip() for v in ([value] if isinstance(value, str) else value) if str(v).strip()]


def read_ctr(content: bytes) -> dict:
    """A MATLAB contour: `fcontour` as it is, or `freqContour` without its last value."""
    v = mat5.read(content)
    if "fcontour" in v:
        freq = v["fcontour"].ravel(order="F").tolist()
    elif "freqContour" in v:
        freq = v["freqContour"].ravel(order="F").tolist()
        freq = freq[:-1] if len(freq) > 1 else freq
    else:
        raise ValueError("neither fcontour nor freqContour is in the file")
    scalar = lambda k: float(v[k].ravel()[0]) if k in v else None
    tempres, length = scalar("tempres"), scalar("ctrlength")
    if length is None and tempres is not None:
        length = len(freq) * tempres
    return {"freq": freq, "tempres": tempres, "ctrlength": length, "ref_id": v["id"].strip() if isinstance(v.get("id"), str) else None, "parent_ids": _texts(v["parent_ids"]) if "parent_ids" in v else None}


def parse(paths: list[str], contents: list[bytes], column: int = 0) -> pa.RecordBatch:
    """A row (PARSED) for each file."""
    read = {"csv": lambda c: read_csv(c, column), "txt": lambda c: read_txt(c, column), "ctr": read_ctr}
    rows = []
    for path, content in zip(paths, contents, strict=True):
        stem, ext = posixpath.splitext(posixpath.basename(path))
        row = {"name": stem, "source_format": ext[1:].lower(), "path": path}
        try:
            row |= read[row["source_format"]](content)
        except UNREADABLE as e:
            row["error"] = f"{type(e).__name__}: {e}"
        rows.append(row)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)


def _parsed(files: DataFrame, column: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield parse(batch.column("path").to_pylist(), batch.column("content").to_pylist(), column)

    return files.select("path", "content").mapInArrow(run, PARSED)


def load_contours(spark: SparkSession, directory: str, file_format: str = "auto", frequency_column: int = 0, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(contours, failed) of a directory. failed: path, error."""
    if file_format != "auto" and file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    wanted = FORMATS if file_format == "auto" else (file_format,)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(directory)
    if not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(directory)
    glob = "{" + ",".join(f"{pattern}.{x}" for x in wanted) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    if files.select("path").isEmpty():
        raise ValueError(f"no contour file in {directory}")
    parsed = materialize(_parsed(files, frequency_column))  # each file is read and parsed once
    good = parsed.filter("error is null").drop("error")
    if good.isEmpty():
        raise ValueError(f"no file in {directory} could be read")
    order = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("source_format"))
    return numbered(good, "contour_id", order, "path").select("contour_id", *good.columns), parsed.filter("error is not null").select("path", "error")


#: Parameters of a saved categorisation: name in the file, name here, value where the file has none (fixed values).
NET = (("vigilance", "vigilance", 85.0), ("bias", "bias", 0.0), ("learningRate", "learning_rate", 0.1), ("maxNumCategories", "max_categories", 50), ("maxNumIterations", "max_iterations", 50))


def read_categorisation(content: bytes) -> dict:
    """parameters, weight (list of prototypes, NaN kept) and rows (name, freq, category from 0, match) of a saved MATLAB categorisation."""
    v = mat5.read(content)
    if "NET" not in v:
        raise ValueError("NET is not in the file")
    net = v["NET"][0]
    w = net["weight"]
    w = w.T if w.shape[0] == 1 else w
    number = lambda d, k, other: float(d[k].ravel()[0]) if k in d and not isinstance(d[k], str) and d[k].size else other
    params = {here: type(other)(number(net, there, other)) for there, here, other in NET}
    params |= {"n_categories": int(number(net, "numCategories", w.shape[1])), "max_features": int(number(net, "numFeatures", w.shape[0]))}
    rows = []
    data = v.get("DATA")
    for d in data if isinstance(data, list) else []:
        c, m = number(d, "category", math.nan), number(d, "match", math.nan)
        rows.append({"name": d["name"] if isinstance(d.get("name"), str) else "", "freq": d["contour"].ravel(order="F").tolist() if "contour" in d else [], "category": None if math.isnan(c) else int(c) - 1, "match": m if math.isfinite(m) else None})
    return {"parameters": params, "weight": [w[:, j].tolist() for j in range(w.shape[1])], "rows": rows}


_SAVED = "source string, parameters map<string, double>, category int, weight array<double>, contour_id long, name string, freq array<double>, match double, error string"
_SAVED_TYPES = [pa.string(), pa.map_(pa.string(), pa.float64()), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.string()]


def load_categorisations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all saved MATLAB categorisations at a path (a file, a directory or a glob), told apart by `source`, the stem of their file.

    parameters: source, parameters. prototypes: source, category, weight. assignments: source, contour_id, name, freq, category, match. failed: source, error. Files are parsed where
    they are read, each once.
    """

    def run(batches):
        for batch in batches:
            for at, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                source = posixpath.splitext(posixpath.basename(at))[0]
                try:
                    got = read_categorisation(content)
                except UNREADABLE as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                else:
                    rows = [{"parameters": [(k, float(v)) for k, v in got["parameters"].items()]}]
                    rows += [{"category": k, "weight": w} for k, w in enumerate(got["weight"])]
                    rows += [{"contour_id": i, **r} for i, r in enumerate(got["rows"])]
                names = [x.split()[0] for x in _SAVED.replace("map<string, double>", "map").split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([{"source": source, **r}.get(f) for r in rows], t) for f, t in zip(names, _SAVED_TYPES, strict=True)], names=names)

    rows = materialize(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SAVED))
    return {
        "parameters": rows.filter("parameters is not null").select("source", "parameters"), "prototypes": rows.filter("weight is not null").select("source", "category", "weight"),
        "assignments": rows.filter("contour_id is not null").select("source", "contour_id", "name", "freq", "category", "match"), "failed": rows.filter("error is not null").select("source", "error"),
    }


def load_categorisation(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(parameters, prototypes, assignments with freq and name) of one saved MATLAB categorisation."""
    t = load_categorisations(spark, path)
    for r in t["failed"].limit(1).collect():
        raise ValueError(r.error)
    found = t["parameters"].limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} is not one file")
    return {k: int(v) if k.startswith(("max_", "n_")) else v for k, v in found[0].parameters.items()}, t["prototypes"].drop("source"), t["assignments"].drop("source")


def load_assignments(spark: SparkSession, path: str) -> DataFrame:
    """contour_name, category, match of an exported CSV."""
    return spark.read.csv(path, header=True, schema="contour_name string, category string, match double")
