"""Byte-level BPE by ranks: overlapping chunk encoding and byte decoding.

A text is cut into chunks of ``chunk_chars`` code points that reach ``overlap``
into the next one. Chunks are scanned for pre-token boundaries apart from each
other, in any task; a scan that begins inside a pre-token goes wrong only until it
meets a boundary of its predecessor's scan, and from such a common boundary on both
agree. So the first common boundary in the overlap (one that white space does not
precede: how white space is split depends on what follows) is where two chunks are stitched,
and the pieces between stitches are encoded apart again. The first scan begins at
the text's start, so by induction all stitches are boundaries of the whole text's
scan. Where an overlap holds no common boundary (a run longer than the overlap), that
document is put together and scanned from its start.

A text within one chunk needs no stitch and is encoded where it lies, without a
shuffle; only longer ones are dealt out by (row, chunk).
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODERS: dict = {}


class _Coder:
    """Scans, encodes and decodes by a rank file and a pattern; pre-tokens met before
    are looked up (the store is emptied when full)."""

    def __init__(self, ranks_path: str, pattern: str, max_parts: int = 300_000):
        import base64

        import regex
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.raw = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.max_parts = max_parts

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens begin, and the end."""
        return [m.start() for m in self.pattern.finditer(text)] + [len(text)]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known = self.known
        if len(known) > self.max_parts:
            known.clear()
        found = self.pattern.findall(text)
        for p in found:
            if p not in known:
                own = array("I", self.encoding.encode_ordinary(p))
                if sys.byteorder != "little":
                    own.byteswap()
                known[p] = own.tobytes()
        return b"".join([known[p] for p in found])

    def decode(self, ids) -> bytes:
        return b"".join([self.raw[i] for i in ids])


def coder(ranks_path: str, pattern: str) -> _Coder:
    """Kept for the life of a worker."""
    key = (ranks_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = _Coder(*key)
    return _CODERS[key]


def _chunker(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = -(-len(text) // chunk)
                for i in range(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([key], pa.int64()), pa.array([i], pa.int32()),
                         pa.array([n], pa.int32()),
                         pa.array([text[i * chunk:(i + 1) * chunk + overlap]], pa.string())],
                        names=["row", "key", "i", "n", "window"])

    return cut


def _scanner(ranks_path: str, pattern: str, chunk: int, overlap: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in batches:
            heads, tails = [], []
            for i, n, window in zip(*(batch.column(x).to_pylist() for x in ("i", "n", "window"))):
                # the last match of a window that the text goes on behind may be cut short
                at = c.boundaries(window)
                sure = at[:-2] if i < n - 1 and len(window) == chunk + overlap else at
                heads.append([b for b in sure if b < overlap] if i else [0])
                # behind white space a piece's end would look different from inside the text
                tails.append([b - chunk for b in sure if chunk <= b < chunk + overlap
                              and not window[b - 1].isspace()])
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=batch.schema.names + ["head", "tail"])

    return scan


def _encoder(ranks_path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in batches:
            texts, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            for at in range(0, batch.num_rows, 256):
                out = [c.ids(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.slice(at, 256) for x in rest] + [pa.array(out, pa.binary())],
                                                 names=batch.schema.names[:-1] + ["ids"])

    return encode


def encode(docs: DataFrame, ranks_path: str, pattern: str, key_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """``key, ids`` per row of ``docs``: little-endian unsigned 32-bit ids.

    A null text is empty and has no ids; a null key stays null; rows with equal keys
    stay separate rows. Other columns are dropped.
    """
    from marquee.session import written

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(key_col).cast("long").alias("key"), text.alias("text"))
    pieces_to_ids = _encoder(ranks_path, pattern)
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(pieces_to_ids, "key long, ids binary")

    long = (rows.where(F.length("text") > chunk_chars)
            .select(F.monotonically_increasing_id().alias("row"), "key", "text")
            .mapInArrow(_chunker(chunk_chars, overlap), "row long, key long, i int, n int, window string")
            .repartition("row", "i")
            .mapInArrow(_scanner(ranks_path, pattern, chunk_chars, overlap),
                        "row long, key long, i int, n int, window string, head array<int>, tail array<int>"))
    scanned = written(long, "scanned")  # read several times below
    before = scanned.select("row", (F.col("i") + 1).alias("i"), F.col("tail").alias("was"))
    stitch = scanned.select("row", "i", "head").join(before, ["row", "i"], "left").select(
        "row", "i", F.when(F.col("i") == 0, F.lit(0)).otherwise(
            F.array_min(F.array_intersect("head", "was"))).alias("at"))
    lost = stitch.where(F.col("at").isNull()).select("row").distinct()
    ends = stitch.select("row", (F.col("i") - 1).alias("i"), F.col("at").alias("to"))
    piece = F.col("window").substr(F.col("at") + 1, F.coalesce(F.col("to") + chunk_chars, F.length("window"))
                                   - F.col("at"))
    stitched = (scanned.join(lost, "row", "left_anti").join(stitch, ["row", "i"]).join(ends, ["row", "i"], "left")
                .select("row", "key", "i", piece.alias("text")))
    whole = (scanned.join(lost, "row", "left_semi")
             .select("row", "key", F.struct("i", F.col("window").substr(1, chunk_chars).alias("core")).alias("c"))
             .groupBy("row", "key").agg(F.array_sort(F.collect_list("c")).alias("c"))  # one document's chunks
             .select("row", "key", F.lit(0).alias("i"), F.array_join("c.core", "").alias("text")))
    encoded = stitched.unionByName(whole).mapInArrow(pieces_to_ids, "row long, key long, i int, ids binary")
    joined = (encoded.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
              .select("key", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")))
    return short.unionByName(joined)


def _decoder(ranks_path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        c = coder(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 256):
                rest = [x.slice(at, 256) for x in batch.columns]
                out = [c.decode(np.frombuffer(b, "<u4").tolist()) for b in ids.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(rest + [pa.array(out, pa.binary())],
                                                 names=batch.schema.names + ["bytes"])

    return decode


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``key, ids`` plus ``bytes``, the concatenated raw bytes of the ids."""
    return encoded.select("key", "ids").mapInArrow(_decoder(ranks_path, pattern), "key long, ids binary, bytes binary")


def _digester(ranks_path: str, pattern: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        c = coder(ranks_path, pattern)
        words = {i: str(i) for i in c.raw}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                n, ids_sha, raw_sha = [], [], []
                for ids in batch.column("ids").slice(at, 256):
                    own = np.frombuffer(ids.as_buffer(), "<u4").tolist()
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(" ".join([words[i] for i in own]).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(c.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, 256), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(raw_sha, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``key, n_tokens`` and SHA-256 of the decimal ids joined by one space and of the
    bytes that the ids decode to."""
    return encoded.select("key", "ids").mapInArrow(
        _digester(ranks_path, pattern), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
