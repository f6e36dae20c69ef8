"""Column expressions on contours (`freq array<double>`), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = r"(?i)[.](ctr|csv|txt)$"


def ratio(a: Column, b: Column) -> Column:
    """100 * smaller / larger; a larger value of 0 counts as 1e-10."""
    top = F.greatest(a, b)
    return F.least(a, b) / F.when(top == 0, F.lit(1e-10)).otherwise(top) * 100


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_weight(weight: Column) -> Column:
    """The positive finite values."""
    return F.filter(weight, lambda x: finite(x) & (x > 0))


def length_ratio_ok(m: Column, n: Column, w: int = 3) -> Column:
    """Whether lengths are near enough for a warp: max / (min - 1) < w, or one point against one; null without a length."""
    low = F.least(m, n)
    return F.when(m.isNotNull() & n.isNotNull(), ((m == 1) & (n == 1)) | ((low > 1) & (F.greatest(m, n) < w * (low - 1))))


def match(contour: Column, weight: Column) -> Column:
    """Per cent match of a contour on a prototype of its length: over positions where the prototype is positive and finite; other lengths are an error."""
    pairs = F.filter(F.arrays_zip(contour.alias("c"), weight.alias("w")), lambda p: finite(p["w"]) & (p["w"] > 0))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.least(p["c"], p["w"]) / F.greatest(p["c"], p["w"]))
    value = F.when(F.size(pairs) == 0, F.lit(0.0)).otherwise(total / F.size(pairs) * 100)
    return F.when(F.size(contour) == F.size(weight), value).otherwise(F.raise_error(F.lit("contour and prototype differ in length")).cast("double"))


def gather(contour: Column, warp: Column) -> Column:
    return F.transform(warp, lambda j: F.get(contour, j))


def unwarp(warp: Column) -> Column:
    """The inverse of a warp: the first place of each input point, else the one before, else 0."""
    none = F.array().cast("array<int>")
    step = lambda acc, i: F.concat(acc, F.array(F.coalesce((F.nullif(F.array_position(warp, i), F.lit(0)) - 1).cast("int"), F.get(acc, F.size(acc) - 1), F.lit(0))))
    return F.when(F.size(warp) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.element_at(warp, -1)), none, step))


def lerp(values: Column, at: Column) -> Column:
    """values at a fractional position."""
    left = F.greatest(F.least(F.floor(at).cast("int"), F.size(values) - 2), F.lit(0))
    low = F.get(values, left)
    return low + (F.coalesce(F.get(values, left + 1), low) - low) * (at - left)


def spread(values: Column, length: Column) -> Column:
    """values at `length` evenly spaced positions, ends kept; one position is the first."""
    last = (F.size(values) - 1).cast("double")
    return F.transform(F.sequence(F.lit(0), length - 1), lambda t: lerp(values, F.when(length == 1, F.lit(0.0)).otherwise(t * last / (length - 1))))


def resampled_length(n: Column, tempres: Column, interval: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(1 + (n - 1) / (interval / tempres)).cast("int"))


def resample(freq: Column, tempres: Column, interval: Column) -> Column:
    """A contour of `tempres` seconds per point at about `interval`."""
    bad = (tempres <= 0) | (interval <= 0)
    good = F.when(F.size(freq) < 2, freq).otherwise(spread(freq, resampled_length(F.size(freq), tempres, interval)))
    return F.when(bad, F.raise_error(F.lit("time steps must be positive")).cast("array<double>")).otherwise(good)


def cap_length(freq: Column, longest: int) -> Column:
    if longest < 1:
        raise ValueError("the longest length must be 1 or more")
    return F.when(F.size(freq) > longest, spread(freq, F.lit(longest))).otherwise(freq)


def safe_tempres(tempres: Column, default: float) -> Column:
    return F.coalesce(F.when(tempres > 0, tempres), F.lit(default))


def first_fault(freq: Column) -> Column:
    """The first rule that a contour breaks, null if none."""
    return (
        F.when(freq.isNull(), "missing")
        .when(F.size(freq) == 0, "empty")
        .when(F.exists(freq, lambda x: F.coalesce(F.isnan(x), F.lit(True))), "nan")
        .when(F.exists(freq, lambda x: F.abs(x) == float("inf")), "infinite")
        .when(F.exists(freq, lambda x: x <= 0), "not_positive")
    )


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), EXTENSIONS, "")


def auto_name(position: Column) -> Column:
    return F.format_string("contour_%04d", position)


#: The namespace of this engine's ids (a fixed value).
NAMESPACE = "6f1c0d52-7b0e-4c58-9f3a-2d1f0a5b8e47"


def name_id(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name: the same whenever and wherever it is computed."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fixed(x: Column) -> Column:
    """A value as text with one decimal, exact halves to even, at least seven wide."""
    text = F.translate(F.format_number(x, 1), ",", "")
    return F.lpad(text, F.greatest(F.length(text), F.lit(7)), F.lit(" "))
