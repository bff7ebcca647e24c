"""Column expressions that the operators and queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash28(*parts: Column | str) -> Column:
    """28 bits of md5 over the parts joined by ':'; any engine with md5 gives the same number."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def hash_order(seed: int | Column, key: Column) -> Column:
    """Pseudo-random order of keys, as text."""
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), key.cast("string")).cast("binary"))


def city_base_name(c: Column) -> Column:
    """What stands before the first comma."""
    return F.trim(F.substring_index(c, ",", 1))


def money_label(x: Column) -> Column:
    """$1.2M, $340k or $75."""
    return F.when(x >= 1e6, F.format_string("$%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("$%.0fk", x / 1e3)).otherwise(F.format_string("$%.0f", x))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def first_match_in_json_array(text: Column, box: tuple[float, float, float, float], x: str = "lat", y: str = "lon") -> Column:
    """The first element of a JSON array of {lat, lon} inside the box, or null; numbers may be strings."""
    parsed = F.from_json(text, f"array<struct<{x}:string,{y}:string>>")
    typed = F.transform(parsed, lambda p: F.struct(p[x].try_cast("double").alias(x), p[y].try_cast("double").alias(y)))
    return F.try_element_at(F.filter(typed, lambda p: F.coalesce(in_box(p[x], p[y], box), F.lit(False))), F.lit(1))


def distance(a: Sequence[Column], b: Sequence[Column], metric: str, p: float = 3.0) -> Column:
    """Between named columns: sqeuclidean, euclidean, manhattan, chebyshev or minkowski."""
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    total = lambda terms: sum(terms[1:], terms[0])
    if metric == "sqeuclidean":
        return total([g * g for g in gaps])
    if metric == "euclidean":
        return F.sqrt(total([g * g for g in gaps]))
    if metric == "manhattan":
        return total(gaps)
    if metric == "chebyshev":
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    if metric == "minkowski":
        return F.pow(total([F.pow(g, F.lit(p)) for g in gaps]), F.lit(1.0 / p))
    raise ValueError(metric)


def array_distance(a: Column, b: Column) -> Column:
    """Squared euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; null when undefined."""
    d = lambda c: c.cast("double")
    tp, fp, tn, fn = d(tp), d(fp), d(tn), d(fn)
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(under > 0, (tp * tn - fp * fn) / under)
