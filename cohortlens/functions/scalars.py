"""Scalar functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, not again for each element of a lambda in it."""
    return F.transform(F.array(value), fn)[0]


def parse_subject(name: Column, per_class: Column) -> Column:
    """``nameN`` -> (N mod P, N div P), ``a (b)`` -> (b - 1, a), a bare number a -> (0, a); else NULL. A struct (subject, pos)."""
    pair = F.regexp_extract(name, r"^([0-9]+) \(([0-9]+)\)$", 1), F.regexp_extract(name, r"^([0-9]+) \(([0-9]+)\)$", 2)
    n = F.regexp_extract(name, r"^[A-Za-z]+([0-9]+)$", 1).try_cast("int")
    out = lambda s, p: F.struct(s.cast("int").alias("subject"), p.cast("int").alias("pos"))
    return (
        F.when(n.isNotNull(), out(n % per_class, F.floor(n / per_class)))
        .when(pair[0] != "", out(pair[1].try_cast("int") - 1, pair[0].try_cast("int")))
        .when(name.rlike("^[0-9]+$"), out(F.lit(0), name.try_cast("int")))
    )


def position_one_hot(pos: Column, width: int = 4, slots: int = 8) -> Column:
    """Flags of min(pos div width, slots - 1)."""
    slot = F.least(F.floor(pos / width), F.lit(slots - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: (k == slot).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, in two halves (a signed long can't hold 64 bits)."""
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def argmax(p: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def scaled(p: Column) -> Column:
    """Values divided by their sum."""
    return once(total(p), lambda t: F.transform(p, lambda x: x / t))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """exp(x / T), scaled to sum 1 (shifted by the maximum, so that nothing overflows)."""
    return scaled(once(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) / temperature))))


def dot(a: Column, b: Column) -> Column:
    """G5, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return once(F.sqrt(dot(a, a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def centred(a: Column) -> Column:
    """Without its mean."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)
    return once(mean, lambda m: F.transform(a, lambda x: x.cast("double") - m))


def class_map(classes: Sequence[str], p: Column) -> Column:
    """Class -> probability."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), p)


def align_classes(known: Column, p: Column, classes: Sequence) -> Column:
    """Probabilities of ``known`` classes in the order of ``classes``; absent ones 0."""
    m = F.map_from_arrays(known, p)
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(c)), F.lit(0.0)) for c in classes])


def ordinal_probabilities(over: Column, floor: float = 1e-6) -> Column:
    """P(y > k) for k = 0.. (made non-increasing) -> class probabilities, at least ``floor``, scaled."""
    down = F.transform(over, lambda _, i: F.array_min(F.slice(over, F.lit(1), i + 1)))
    upper, lower = F.concat(F.array(F.lit(1.0)), down), F.concat(down, F.array(F.lit(0.0)))
    return scaled(F.zip_with(upper, lower, lambda a, b: F.greatest(a - b, F.lit(floor))))


def decision(p: Column, threshold: float = 0.5, min_confidence: float = 0.1) -> Column:
    """Struct of class (p >= threshold), risk (probability of that class), margin |p - 0.5| and uncertain."""
    positive = p >= threshold
    margin = F.abs(p - 0.5)
    return F.struct(positive.cast("int").alias("predicted"), F.when(positive, p).otherwise(1 - p).alias("risk"), margin.alias("margin"), (margin < min_confidence).alias("uncertain"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def shorten(text: Column, most: int) -> Column:
    """G1: cut to ``most`` characters, the last three being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
