"""Removal of every byte that a repeated 200-byte string covers, by anchors and buckets.

Positions of all texts are suffixes; two belong together when their first ``length``
bytes agree. Suffixes fall into buckets of a q-gram, and what shares a bucket is told apart by fingerprints
of the rest of the string, in one step: this is not the recursive refinement by bucket
pointers (no bucket identifiers of later offsets, no order of suffixes), which a row per byte
would need. Three things keep it linear in the input:

* *Anchors stand for suffixes.* Of the q-grams in a string of ``length`` bytes the one
  with the smallest hash is its anchor (the first, if equal). Equal strings have equal
  anchors at equal offsets, and neighbouring positions share theirs, so one row stands
  for a run of positions: about 2 rows per ``length - q`` bytes.
* *Buckets*: rows by the q-gram at the anchor (initial bucket), refined by the bytes of
  the whole run, from the run's first byte to the end of its last string. A bucket of
  one row has no repeat. Rows of equal runs repeat all their strings: decided.
* *What is left* - rows alone in their run's bucket but not in their q-gram's, at the
  ends of repeated passages - is compared position by position: by the pair of fingerprints
  of the q-gram and of the rest of the string, together
  with one row of each decided run of the same q-gram. That takes place within the
  q-gram's bucket; one of more than ``group_runs`` runs goes string by string through
  an aggregate instead.

Scale: a map task sends equal runs once (with a count), the other copies' places are
known to repeat at once, so a passage that a third of all documents hold is one row
per task; buckets are counted by aggregates with map-side combine and joined back,
no bucket of more than ``group_runs`` rows is gathered. Places are gathered per document,
no more than its own runs. Texts are shuffled by document, twice at most. Fingerprints have 64 bits each and
are compared in pairs (q-gram and run, or q-gram and rest), so 128 bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.hashing import Prefix, mix, text_slices
from marquee.llm.workers import shielded, slices, store
from marquee.session import written

RUNS = "key long, mark long, lo int, hi int, bucket long, run long, n long"
_FLUSH = 1 << 19


def _first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value in every window of ``width`` values."""
    at = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        at = np.minimum(at[:len(at) - span], at[span:])
        span *= 2
    n = len(values) - width + 1
    return (np.minimum(at[:n], at[width - span:width - span + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Runs of positions with one anchor: ``(text, lo, hi, bucket, run)`` arrays; positions
    lo .. hi are offsets in the text, all of them starts of a whole string."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    spans = Prefix(data)
    grams = mix(spans.span(np.arange(len(data) - q + 1), np.arange(q, len(data) + 1)), 1)
    anchor = _first_min(grams, length - q + 1)  # per start, over all texts of the slice
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    whole = np.arange(len(anchor)) + length <= offsets[1:][text]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    last = whole.copy()
    last[:-1] &= first[1:] | ~whole[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = anchor[lo]
    with np.errstate(over="ignore"):
        run = mix(spans.span(lo, hi + length), 2) ^ mix(((at - lo) << 32 | (hi - lo)).astype(np.uint64), 3)
    t = text[lo]
    return t, lo - offsets[t], hi - offsets[t], grams[at].view(np.int64), run.view(np.int64)


def _sliced(texts: pa.Array, most: int, overlap: int):
    """Slices as of :func:`text_slices`, but a longer text in pieces that overlap:
    ``(rows, data, offsets, shift)``, shift being the first byte's place in its text."""
    for row, data, offsets in text_slices(texts, most_bytes=most):
        if len(data) <= 2 * most:
            yield row, data, offsets, 0
        else:
            for a in range(0, len(data) - overlap, most):
                part = data[a:a + most + overlap]
                yield row, part, np.array([0, len(part)]), a


def _run_finder(length: int, q: int, most: int):
    names = ["key", "mark", "lo", "hi", "bucket", "run", "n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            key, known, mark, lo, hi, bucket, run = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((run, bucket))
            b, r = bucket[order], run[order]
            new = np.ones(len(b), dtype=bool)
            new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            n = np.zeros(len(b), dtype=np.int64)  # 0: repeats a row of this task, which stands for it
            n[order[new]] = count
            again = n == 0
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64(), mask=~known), pa.array(mark, pa.int64()), pa.array(lo, pa.int32()),
                 pa.array(hi, pa.int32()), pa.array(bucket, pa.int64(), mask=again),
                 pa.array(run, pa.int64(), mask=again), pa.array(n, pa.int64())], names=names)

        size = 0
        for batch in batches:
            keys, marks, texts = (batch.column(i) for i in range(3))
            known_all = keys.is_valid().to_numpy(zero_copy_only=False)
            key_all = keys.fill_null(0).to_numpy(zero_copy_only=False)
            mark_all = marks.to_numpy(zero_copy_only=False)
            for row, data, offsets, shift in _sliced(texts, most, length - 1):
                text, lo, hi, bucket, run = text_runs(data, offsets, length, q)
                text = text + row
                held.append((key_all[text], known_all[text], mark_all[text], lo + shift, hi + shift, bucket, run))
                size += len(lo)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return find


def _span_sender(length: int):
    """Every asked run with its bytes, from its first position to the end of its last string."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = memoryview(row.column("text")[0].as_buffer())
                lo, hi = (row.column(c).flatten() for c in ("lo", "hi"))
                spans = [bytes(text[x:y + length]) for x, y in zip(lo.to_pylist(), hi.to_pylist())]
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column("key")[0].as_py()] * n, pa.int64()),
                     pa.array([row.column("mark")[0].as_py()] * n, pa.int64()), lo, row.column("bucket").flatten(),
                     row.column("runs").flatten(), row.column("open").flatten(), pa.array(spans, pa.binary())],
                    names=["key", "mark", "lo", "bucket", "runs", "open", "span"])

    return send


def _strings(spans: list[bytes], length: int, q: int):
    """(span, offset, head, rest) of every string of ``length`` bytes in the spans."""
    size = np.array([len(x) for x in spans], dtype=np.int64)
    starts = np.cumsum(size) - size
    many = size - length + 1
    own = np.repeat(np.arange(len(spans)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = starts[own] + offset
    prefix = Prefix(np.frombuffer(b"".join(spans), dtype=np.uint8))
    head = mix(prefix.span(at, at + q), 1).view(np.int64)
    return own, offset, head, mix(prefix.span(at + q, at + length), 4).view(np.int64)


def _bucket_resolver(length: int, q: int):
    def resolve(table: pa.Table) -> pa.Table:
        own, offset, head, rest = _strings(table["span"].to_pylist(), length, q)
        order = np.lexsort((rest, head))
        same = (head[order][1:] == head[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        twice = np.zeros(len(own), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        open_ = table["open"].combine_chunks().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(twice & open_[own])  # in order of run and offset
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(own[at]) > 0)
        first, last = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] if len(at) else at
        who = own[first]
        start = table["lo"].combine_chunks().to_numpy(zero_copy_only=False)[who]
        return pa.table({"key": table["key"].combine_chunks().take(pa.array(who)),
                         "mark": table["mark"].combine_chunks().take(pa.array(who)),
                         "lo": pa.array(start + offset[first], pa.int32()),
                         "hi": pa.array(start + offset[last], pa.int32())})

    return resolve


def _position_finder(length: int, q: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                own, offset, head, rest = _strings(rows.column("span").to_pylist(), length, q)
                who = pa.array(own)
                lo = rows.column("lo").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").take(who), rows.column("mark").take(who), pa.array(lo[own] + offset, pa.int32()),
                     rows.column("bucket").take(who), pa.array(head), pa.array(rest), rows.column("open").take(who)],
                    names=["key", "mark", "at", "bucket", "head", "rest", "open"])

    return find


def _keyed(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Rows alike in key and text are one document here; ``mark`` is the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _same(a, b):
    return a["key"].eqNullSafe(b["key"]) & (a["mark"] == b["mark"])


def repeated_starts(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = 200,
                    q: int = 40, slice_bytes: int = 1 << 20, group_runs: int = 20_000) -> DataFrame:
    """``key, mark, lo, hi``: ranges of byte positions where a string of ``length`` bytes
    starts that starts elsewhere too. ``mark`` is the hash of the text.

    A text shorter than ``length`` bytes has no such position. The rows of a key that
    are alike in text too are told apart for counting, and share their ranges.
    """
    texts = _keyed(docs, key_col, text_col)
    runs = written(texts.where(F.octet_length("text") >= length)
                   .mapInArrow(_run_finder(length, q, slice_bytes), RUNS), "runs")
    first = runs.where("n > 0")
    repeated = first.groupBy("bucket").agg(F.sum("n").alias("t")).where("t > 1").select("bucket")
    live = written(first.join(repeated, "bucket", "left_semi"), "live")
    classes = written(live.groupBy("bucket", "run").agg(
        F.sum("n").alias("n"), F.min(F.struct("key", "mark", "lo", "hi")).alias("place")), "classes")
    again = runs.where("n <> 1").select("key", "mark", "lo", "hi")  # repeated within a task
    known = classes.where("n > 1").select("bucket", "run")
    decided = again.unionByName(live.where("n = 1").join(known, ["bucket", "run"], "left_semi")
                                .select("key", "mark", "lo", "hi"))

    # buckets with more than one run, one of which at least is alone
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).where(
        "runs > 1 AND least = 1").select("bucket", "runs")
    asked = (classes.join(mixed, "bucket")
             .select("bucket", "runs", "place.*", (F.col("n") == 1).alias("open"))
             .groupBy("key", "mark").agg(F.collect_list(F.struct("lo", "hi", "bucket", "runs", "open")).alias("r")))
    # equal rows of documents meet the same request, but have no run that is alone
    spans = written(texts.join(asked, _same(texts, asked)).select(
        texts["key"], texts["mark"], F.col("text").cast("binary").alias("text"),
        *[F.col(f"r.{c}").alias(c) for c in ("lo", "hi", "bucket", "runs", "open")]).mapInArrow(
        _span_sender(length),
        "key long, mark long, lo int, bucket long, runs long, open boolean, span binary"), "spans")
    late = (spans.where(F.col("runs") <= group_runs).groupBy("bucket")
            .applyInArrow(_bucket_resolver(length, q), "key long, mark long, lo int, hi int"))
    # a bucket of very many runs is counted string by string, with map-side combine
    places = spans.where(F.col("runs") > group_runs).mapInArrow(
        _position_finder(length, q),
        "key long, mark long, at int, bucket long, head long, rest long, open boolean")
    string = ["bucket", "head", "rest"]
    twice = places.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*string)
    hot = places.where("open").join(twice, string, "left_semi").select(
        "key", "mark", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return decided.unionByName(late).unionByName(hot)


def _cutter(length: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        store("suffix_dedup")
        for batch in slices(batches):
            texts, lists = batch.column("_text").to_pylist(), (batch.column("_lo"), batch.column("_hi"))
            los, his = (x.to_pylist() for x in lists)
            n_bytes, removed, spans, digest, kept = [], [], [], [], []
            for text, lo, hi in zip(texts, los, his):
                gone = np.zeros(0, dtype=np.int64)
                if lo:
                    order = np.argsort(lo, kind="stable")
                    a, b = np.array(lo, dtype=np.int64)[order], np.array(hi, dtype=np.int64)[order] + length
                    reach = np.maximum.accumulate(b)
                    new = np.concatenate([[True], a[1:] > reach[:-1]])
                    a, b = a[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]
                    gone = b - a
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                    own = b"".join([text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)])
                    if with_text:
                        whole = _characters(text, edges)
                else:
                    own = whole = text
                n_bytes.append(len(text))
                removed.append(int(gone.sum()))
                spans.append(len(gone))
                digest.append(hashlib.sha256(own).hexdigest())
                kept.append(whole.decode("utf-8", "replace") if with_text else None)
            rest = [n for n in batch.schema.names if n not in ("_text", "_lo", "_hi")]
            columns = [batch.column(n) for n in rest] + [
                pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(digest, pa.string())]
            names = rest + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _characters(text: bytes, edges: list[int]) -> bytes:
    """The kept bytes, but with every character whole that a removed span only touches."""
    out = [text[:edges[1]]]
    for i in range(1, len(edges) - 1, 2):
        a, b = edges[i], edges[i + 1]
        start = a
        while start < len(text) and start > 0 and text[start] & 0xC0 == 0x80:
            start -= 1
        if start < a:  # the span begins inside a character: keep that one's rest
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            out.append(text[edges[i]:a])
        stop = b
        if stop < len(text) and text[stop] & 0xC0 == 0x80:  # it ends inside one: keep that one's beginning
            while stop > a and text[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(text[stop:b])
        out.append(text[b:edges[i + 2]])
    return b"".join(out)


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   q: int = 40, with_text: bool = True, slice_bytes: int = 1 << 20,
                   group_runs: int = 20_000) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_bytes, n_removed, n_spans`` (maximal
    removed runs), ``kept_sha256`` (of the remaining bytes) and, if asked for,
    ``kept_text``: the remaining text, where a character that a removed run only touches
    stays whole (bytes alone may not be text). Input columns of these names are replaced.

    Texts are UTF-8 bytes, a null one is empty; a string counts as repeated if it starts
    at any other position, in the same text or another; matches never cross texts;
    overlaps count; all is judged on the input. Null keys are allowed; equal rows count
    as that many documents, so two equal rows of ``length`` bytes or more lose all.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    found = repeated_starts(docs, key_col, text_col, length, q, slice_bytes, group_runs)
    ranges = found.groupBy("key", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    ranges = ranges.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), "r")
    docs, restored = shielded(docs, key_col, text_col, made=names)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    joined = (docs.join(ranges, F.col(key_col).cast("long").eqNullSafe(F.col("_key"))
                        & (F.xxhash64(text) == F.col("_mark")), "left")
              .select(*rest, text.cast("binary").alias("_text"), F.col("r.lo").alias("_lo"), F.col("r.hi").alias("_hi")))
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest]
                       + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"]
                       + ["kept_text string"] * with_text)
    return restored(joined.mapInArrow(_cutter(length, with_text), schema))
