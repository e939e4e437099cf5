"""Scalar functions of the graph model, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_count(text: Column) -> Column:
    """Line ends in the text: a last line without one isn't counted."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def name_tokens(name: Column) -> Column:
    """Words of a snake or camel name, lower-cased; null if that is the lower-cased name itself.

    A capital after a capital starts no word.
    """
    spaced = F.regexp_replace(name, r"(?<=[^\p{Lu}])(\p{Lu})", " $1")
    words = F.trim(F.lower(F.translate(spaced, "_", " ")))
    return F.when(words != F.lower(name), words)


def signature(source: Column, length: int = 120) -> Column:
    """First line, trimmed, at most ``length`` characters."""
    return F.substring(F.trim(F.split(source, "\n")[0]), 1, length)


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def node_tokens(name: Column, kind: Column, path: Column) -> Column:
    """Cost of a listed node: each part rounded up, and 8 for the line around it."""
    return estimated_tokens(name) + estimated_tokens(kind) + estimated_tokens(path) + 8


ROUTE_LEAST = 8  # what a node of a trace costs at least


def route_tokens(*parts: Column) -> Column:
    """Cost of a node of a trace: a token for four bytes of all parts together, rounded down, and 8."""
    total = sum((F.octet_length(p) for p in parts[1:]), F.octet_length(parts[0]))
    return F.floor(total / 4).cast("long") + ROUTE_LEAST


def truncate_tokens(text: Column, tokens: int) -> Column:
    """At most ``tokens`` tokens' bytes of the text, four each, up to the end of a character; marked where something is cut."""
    raw, most = text.cast("binary"), 4 * tokens
    ends = [F.when(~F.hex(F.substring(raw, most - k + 1, 1)).between("80", "BF"), most - k) for k in range(4)]  # no byte that goes on with a character follows
    cut = F.substring(raw, F.lit(1), F.coalesce(*ends, F.lit(most))).cast("string")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("… [truncated]"))).otherwise(text)


def like_any_case(text: Column, pattern: str) -> Column:
    """LIKE without regard to case; ``_`` and ``%`` of the pattern stay wild."""
    return text.ilike(pattern)


def prefix_query(query: Column) -> Column:
    """Marks the last word as a prefix."""
    return F.when(F.endswith(query, F.lit("*")), query).otherwise(F.concat(query, F.lit("*")))


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(raw: pd.Series) -> pd.Series:
    """The vector of ``vector_bytes``; a last incomplete float is left out."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def relevance(bm25: Column, centrality: Column) -> Column:
    """1 for a perfect match falling towards 0, raised by up to a tenth by centrality."""
    return 1 / (1 + F.abs(bm25)) * (1 + 0.1 * centrality)


def hybrid(rel: Column, cosine: Column) -> Column:
    return F.coalesce(0.6 * rel + 0.4 * cosine, rel)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2_normalised(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_pooled(tokens: Column, mask: Column, width: int) -> Column:
    """Mean of the token vectors whose mask is set; zeros if none is."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda z: z["m"] > 0)
    zero = F.array(*[F.lit(0.0)] * width)
    total = F.aggregate(kept, zero, lambda s, z: F.zip_with(s, z["v"], lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def embed_input(name: Column, sig: Column, doc: Column) -> Column:
    return F.concat_ws(" ", name, sig, doc)


def json_strings(text: Column) -> Column:
    """A JSON list of strings, or an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def split_list(text: Column) -> Column:
    """Items between commas, empty ones left out."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def parent_dir(path: Column) -> Column:
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def short_id(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 8), F.lit("…"))


def stable_id(path: Column) -> Column:
    """Project id from its path: the same on every machine and run."""
    return F.concat(F.lit("prj_"), F.substring(F.md5(path.cast("binary")), 1, 20))


def code_norm(directory: Column, name: Column) -> Column:
    """DIR.NAME in capitals, with underscores for dashes and spaces."""
    return F.concat_ws(".", *[F.translate(F.upper(c), "- ", "__") for c in (directory, name)])


def title_case(text: Column) -> Column:
    """Words between underscores, first characters in capitals, the rest as it is."""
    return F.array_join(F.transform(F.split(text, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def auto_code(stem: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", F.upper(stem), number.cast("int"))


def size_text(size: Column) -> Column:
    """Whole KB up to 1024 of them, else MB with one decimal."""
    kb = F.floor(size / 1024)
    return F.when(kb <= 1024, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.format_string("%.1f MB", size / 1048576.0))


def version_banner(indexed: Column, running: str) -> Column:
    return F.when(indexed.isNull(), "not indexed").when(indexed == running, "up to date").otherwise(F.concat(F.lit("indexed by "), indexed))


def risk(up: Column, down: Column) -> Column:
    total = up + down
    return F.when(total <= 2, "LOW").when(total <= 10, "MEDIUM").when(total <= 30, "HIGH").otherwise("CRITICAL")


def health(symbols: Column, score: Column) -> Column:
    return F.when(symbols == 0, "empty").when(score >= 75, "healthy").when(score >= 40, "partial").otherwise("sparse")


def model_ref(text: Column) -> tuple[Column, Column]:
    """Provider and model of ``provider/model``."""
    return F.split_part(text, F.lit("/"), F.lit(1)), F.regexp_extract(text, "^[^/]*/(.*)$", 1)


#: Limits of each risk tier (lines, complexity, nesting, review percent, least number of tests).
TIERS: Sequence[tuple[str, int, int, int, int, int]] = (("T0", 500, 15, 4, 0, 1), ("T1", 400, 15, 4, 0, 4), ("T2", 300, 10, 3, 20, 8), ("T3", 200, 8, 3, 100, 12))
