"""Text and list column expressions (built-in functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import col


def title_norm(c) -> Column:
    """Search key -- lower case, only ``[a-z0-9]`` kept."""
    return F.regexp_replace(F.lower(col(c).cast("string")), "[^a-z0-9]", "")


def title_link_norm(c) -> Column:
    """P10: linkage key -- lower case, punctuation dropped (word characters
    and spaces kept, Unicode-aware), runs of spaces collapsed, trimmed."""
    x = F.regexp_replace(F.lower(col(c).cast("string")), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def split_list(c, sep: str = "|") -> Column:
    """``a|b||c`` -> [a, b, c]; null or '' -> []."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), "[" + sep + "]")
    return F.filter(parts, lambda x: x != "")


def vocab_filter(arr, vocab: Sequence[str]) -> Column:
    """Keep vocabulary members, preserving order and repeats."""
    allowed = F.array(*[F.lit(v) for v in vocab])
    return F.filter(col(arr), lambda g: F.array_contains(allowed, g))


def director_token(c) -> Column:
    """P25: first listed name, trimmed, lower case, spaces -> '_'; blank -> ''."""
    first = F.get(F.split(F.coalesce(col(c), F.lit("")), "[|]"), 0)
    return F.coalesce(F.replace(F.lower(F.trim(first)), F.lit(" "), F.lit("_")), F.lit(""))
