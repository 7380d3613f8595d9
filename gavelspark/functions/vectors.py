"""Similarity of texts and vectors, and distances on the globe, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

EARTH = 6_371_000.0


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word of a text, the word padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 0 for two empty sets."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(h))


def in_polygon(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lat, lon) corners, by crossings of a ray."""
    inside = F.lit(False)
    for (lat1, lon1), (lat2, lon2) in zip(polygon, polygon[1:] + polygon[:1]):
        if lat1 == lat2:
            continue
        crosses = ((F.lit(lat1) > lat) != (F.lit(lat2) > lat)) & (lon < (lon2 - lon1) * (lat - lat1) / (lat2 - lat1) + lon1)
        inside = inside != crosses
    return inside


def polyline(text: Column, precision: int = 5) -> Column:
    """The points (lat, lon) of an encoded polyline. Each character holds five bits, low ones first, and a sixth that
    says whether more follow; numbers are differences with their sign in the lowest bit."""
    codes = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch) - 63)
    whole = lambda x: x.cast("long")
    numbers = F.array().cast("array<bigint>")
    start = F.struct(whole(F.lit(0)).alias("value"), F.lit(0).alias("shift"), numbers.alias("out"))

    def add(state: Column, code: Column) -> Column:
        value = state["value"] + F.call_function("shiftleft", whole(code.bitwiseAND(F.lit(31))), state["shift"])
        signed = F.when(value % 2 == 1, -((value + 1) / 2).cast("long")).otherwise((value / 2).cast("long"))
        more = code >= 32
        return F.struct(
            F.when(more, value).otherwise(whole(F.lit(0))).alias("value"),
            F.when(more, state["shift"] + 5).otherwise(0).alias("shift"),
            F.when(more, state["out"]).otherwise(F.concat(state["out"], F.array(signed))).alias("out"),
        )

    steps = F.aggregate(codes, start, add, lambda s: s["out"])
    sums = lambda kept: F.aggregate(kept, F.struct(whole(F.lit(0)).alias("at"), numbers.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])
    lat, lon = (sums(F.filter(steps, lambda x, i: i % 2 == odd)) for odd in (0, 1))
    return F.zip_with(lat, lon, lambda y, x: F.struct((y / 10.0**precision).alias("lat"), (x / 10.0**precision).alias("lon")))


def looks_alike(a: Column, b: Column, least: float = 0.30) -> Column:
    """False only when both vectors are known and too far apart."""
    known = (F.size(a) > 0) & (F.size(b) > 0)
    return ~F.coalesce(known, F.lit(False)) | (dot(a, b) >= least)


@F.pandas_udf(BinaryType())
def _to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _from_bytes(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def vector_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats, four bytes a component; null if it or one of its components is null."""
    return _to_bytes(F.when(~F.exists(vector, lambda x: x.isNull()), vector.cast("array<float>")))


def bytes_vector(packed: Column) -> Column:
    """The vector in such bytes; null for no bytes and for a length that no whole number of components has."""
    size = F.octet_length(packed)
    return _from_bytes(F.when((size > 0) & (size % 4 == 0), packed))
