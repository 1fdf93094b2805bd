"""Removal of repeated passages of three lines, keeping the first occurrence.

Lines are what ``\\n`` splits; lines of white space only take no part (they stay).
Every three consecutive other lines are a window; a window's 128-bit hash stands for
its three texts. Of equal windows the first by (doc_id, text hash, line) stays, all
later ones - in other documents or the same - are removed: a document loses every
line that one of its later windows covers, overlaps merged.

Scale: the first place per window is an aggregate with map-side combine, so a
passage that a third of all documents share costs one row a task; the join back has
one row per window on one side, so a hot window can be split. A document's own
removed places (no more than its lines) are gathered per document; the texts are
shuffled once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.workers import shielded
from marquee.session import written

_BLANK = " \t\r\x0b\x0c"
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_filled(line: Column) -> Column:
    return F.translate(line, _BLANK, "") != ""


def later_windows(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, mark, at``: the windows (by number of their first line among the lines
    that are not blank) that occurred before. ``mark`` is the hash of the text."""
    text = F.col(text_col).cast("string")
    keyed = (docs.where(text.isNotNull()).select(
        F.col(key_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"),
        F.filter(_lines(text), _is_filled).alias("filled")).where(F.size("filled") >= WINDOW))
    # a line is hashed once, its windows from the lines' hashes
    hashed = keyed.select("key", "mark", F.transform("filled", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))).alias("m"))
    three = lambda i, f: [F.col("m")[i + n][f] for n in range(WINDOW)]
    found = F.transform(F.sequence(F.lit(0), F.size("m") - WINDOW), lambda i: F.struct(
        F.xxhash64(*three(i, "a")).alias("h1"), F.xxhash64(*three(i, "b")).alias("h2"), i.alias("at")))
    windows = written(hashed.select("key", "mark", F.explode(found).alias("w")).select("key", "mark", "w.*"), "windows")
    place = F.struct("key", "mark", "at")
    first = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    return windows.join(first, ["h1", "h2"]).where(place != F.col("first")).select("key", "mark", "at")


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined again without those whose numbers among the filled ones are gone."""
    filled = F.filter(F.transform(lines, lambda x, i: F.when(_is_filled(x), i)), lambda i: i.isNotNull())
    out = F.transform(F.array(filled), lambda f: F.transform(gone, lambda j: f[j]))[0]
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` with the kept lines as text, and ``n_lines``,
    ``n_removed`` (longs; columns of these names in the input are replaced).

    A null text stays null (0 lines); an empty text is one blank line. Rows with a
    null key come before all others. Rows alike in key and text count as one
    document and get the same answer; rows alike in key only are two documents,
    in order of a hash of their texts.
    """
    base, restored = shielded(docs, key_col, text_col, made=("n_lines", "n_removed"))
    text = F.col(text_col).cast("string")
    gone = later_windows(docs, key_col, text_col).groupBy("key", "mark").agg(F.collect_set("at").alias("later"))
    gone = gone.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), F.col("later").alias("_later"))
    joined = base.join(gone, F.col(key_col).cast("long").eqNullSafe(F.col("_key"))
                       & (F.xxhash64(text) == F.col("_mark")), "left")
    out = F.array_distinct(F.flatten(F.transform("_later", lambda j: F.sequence(j, j + WINDOW - 1))))
    # a one-element transform binds what is used more than once
    new = F.transform(F.array(_lines(text)), lambda lines: F.transform(
        F.array(out), lambda gone: _without(lines, gone))[0])[0]
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    columns = [F.when(F.col("_later").isNotNull(), new).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
               for c in base.columns]
    return restored(joined.select(
        *columns, F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_later").isNotNull(), F.size(out)).otherwise(F.lit(0)).cast("long").alias("n_removed")))
