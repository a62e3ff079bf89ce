"""Fingerprint similarities as column expressions; all of it stays in the JVM."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

SPATIAL_WEIGHT = 0.35
COLOR_WEIGHT_MIN, COLOR_WEIGHT_MAX = 0.3, 0.7
BEST_WEIGHT, SECOND_WEIGHT = 0.75, 0.25


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits over pairs of integer words; explicit words rather than arrays keep it in generated code."""
    return functools.reduce(operator.add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def struct_similarity(distance: Column, bits: int) -> Column:
    return 1 - distance / bits


def quantize_color(histogram: Column) -> Column:
    """Shares of a histogram as whole numbers 0..255, halves upwards."""
    return F.transform(histogram, lambda h: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h)) * 255 + 0.5).cast("int"))


def color_total(color: Column) -> Column:
    return F.aggregate(color, F.lit(0).cast("long"), lambda a, x: a + x)


def dominant_share(color: Column) -> Column:
    return F.coalesce(F.array_max(color), F.lit(0)) / 255


def histogram_similarity(a: Column, a_total: Column, b: Column, b_total: Column) -> Column:
    """Intersection of two histograms, each by its own total, in whole numbers up to one division; 0 if either is empty."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x.cast("long") * b_total, y.cast("long") * a_total)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when((a_total > 0) & (b_total > 0), common / (a_total * b_total)).otherwise(0.0)


def spatial_similarity(a: Column, b: Column) -> Column:
    off = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.greatest(F.lit(0.0), 1 - off / (F.size(a) * 255))


def color_weight(share: Column) -> Column:
    return COLOR_WEIGHT_MIN + (COLOR_WEIGHT_MAX - COLOR_WEIGHT_MIN) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def color_score(histogram: Column, spatial: Column) -> Column:
    return histogram * (1 - SPATIAL_WEIGHT) + spatial * SPATIAL_WEIGHT


def frame_score(hash_score: Column, color: Column, weight: Column) -> Column:
    return hash_score * (1 - weight) + color * weight


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b), F.greatest(a, b)]
