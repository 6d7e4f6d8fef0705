"""Scalar functions (F3, F4, F6-F9, W4) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rough_tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def python_strip(text: Column) -> Column:
    """Without the white space that Unicode (and \\x1c-\\x1f) has at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def caption_text(caption: Column, meta: Column) -> Column:
    """The trimmed caption, and below it when and where the picture was taken, as far as the JSON `meta` says so."""
    m = F.from_json(meta, "taken_at string, place string")
    fields = F.concat_ws(", ", F.nullif(m["taken_at"], F.lit("")), F.nullif(m["place"], F.lit("")))
    return F.concat_ws("\n", python_strip(caption), F.when(fields != "", F.concat(F.lit("Taken: "), fields)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision, 0 if a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero, as DuckDB rounds: in doubles, where Spark's round makes a decimal of each value."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled)
    return F.signum(x) * ((whole + (scaled - whole >= 0.5).cast("int")) / 10.0**digits)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def parse_modalities(text: Column) -> Column:
    """modalities_done as a map; empty where the JSON is broken or missing."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse_visual_payload(text: Column) -> Column:
    """sub_modality of a visual job."""
    return F.from_json(text, "asset_id string, mime string, meta string")


def top_sparse_terms(indices: Column, values: Column, k: int = 5) -> Column:
    """The k terms of largest weight by size, rounded to 4 digits; ties to the smaller index."""
    pairs = F.zip_with(indices, values, lambda i, v: F.struct((-F.abs(v)).alias("order"), i.alias("index"), F.round(v, 4).alias("weight")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["index"].alias("index"), p["weight"].alias("weight")))
