"""Scalar functions on columns: hashes, keys, vectors, angles.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a bar, in hex: a stable sort key."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def unit_interval(digest: Column) -> Column:
    """The first eight bytes of a digest as a share of 2^64."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def split_of(u: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by left-closed cumulative shares."""
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def prefix_key(codes: Column, k: int, depth: int) -> Column:
    """Big-endian key of the first ``depth`` codes: key * k + code at each step."""
    return F.aggregate(F.slice(codes, 1, depth), F.lit(0).cast("long"), lambda key, c: key * k + c)


def joint_key(codes: Column, k: int) -> Column:
    """Little-endian key: the sum of code_l * k^l."""
    return F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda key, c: key * k + c)


def encode_mixed(values: Column, radices: list[int]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, radices)), lambda v, r: F.struct(v.cast("long").alias("v"), r.cast("long").alias("r"))), F.lit(0).cast("long"), lambda key, x: key * x["r"] + x["v"])


def decode_mixed(key: Column, radices: list[int]) -> Column:
    out, weight = [], 1
    for r in reversed(radices):
        out.append(F.pmod(F.floor(key / F.lit(weight)), F.lit(r)).cast("long"))
        weight *= r
    return F.array(*reversed(out))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y)


def cosine(a: Column, b: Column) -> Column:
    """Null unless both norms exceed 1e-8."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > 1e-8) & (nb > 1e-8), dot(a, b) / (na * nb))


def encode_angles(angles: Column) -> Column:
    """Sines, then cosines."""
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def decode_angles(pairs: Column, n: int) -> Column:
    return F.zip_with(F.slice(pairs, 1, n), F.slice(pairs, n + 1, n), lambda s, c: F.atan2(s, c))


def above(value: Column, thresholds: list[Column]) -> Column:
    """How many thresholds are strictly below the value."""
    return sum((F.when(value > t, 1).otherwise(0) for t in thresholds), F.lit(0))


def direction(vector: Column, threshold: float) -> Column:
    """0 at or below the threshold's norm, else 1 + 2 * (first largest axis) + (not negative there)."""
    size = F.transform(vector, F.abs)
    axis = F.array_position(size, F.array_max(size)).cast("int")
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm <= threshold, 0).otherwise(1 + 2 * (axis - 1) + F.when(F.element_at(vector, axis) >= 0, 1).otherwise(0))
