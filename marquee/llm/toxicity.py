"""Toxicity by compression distance to two zstandard dictionaries.

A dictionary each is made from toxic and from ordinary training texts: the words that
hold telling segments (beginnings and ends of words that far more families of texts
of the class have than of the other; near copies are one family) and, in both, the common
words. The windows of a text - its words, cut where they are long - are compressed with both; a
window is written three times over, since zstandard leaves shorter ones raw, so what
counts is how much its first appearance costs. The difference of the two lengths says
which dictionary knows it better. A text's score comes from how many windows the toxic
dictionary compresses better by at least ``near`` and ``far`` bytes, through a logistic
calibration fitted on labelled texts that the dictionaries have not seen.

Training takes a bounded sample: ``per_class`` texts of each label for the dictionaries
and half as many for the calibration, the ones with the smallest hash of their id. The
sample's ids (at most 3 x ``per_class``) are broadcast; the model, some 50 kB, travels with
the tasks. Scoring is one pass over whole texts, without a shuffle. A window met before
is looked up; the store is emptied when full.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.workers import slices, store

_WORD = re.compile(r"[^\W_]+")
WINDOW_CHARS = 40
NEAR, FAR = 2, 4


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def key(self) -> int:
        return zlib.crc32(self.toxic + b"/" + self.ordinary)


def windows(text: str) -> list[str]:
    """The lower-cased words of a text; longer ones in pieces."""
    found = _WORD.findall(text.lower())
    if any(len(w) > WINDOW_CHARS for w in found):
        found = [w[i:i + WINDOW_CHARS] for w in found for i in range(0, len(w), WINDOW_CHARS)]
    return found


class Distance:
    """Length with the ordinary dictionary less length with the toxic one, per window."""

    def __init__(self, toxic: bytes, ordinary: bytes, most: int = 500_000):
        import zstandard
        self.known: dict[str, int] = {}
        self.most = most
        params = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.pair = []
        for content in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            self.pair.append(zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary))

    def __call__(self, found: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        ordinary, toxic = self.pair
        for w in found:
            if w not in known:
                thrice = f" {w} {w} {w} ".encode()
                known[w] = len(ordinary.compress(thrice)) - len(toxic.compress(thrice))
        return [known[w] for w in found]


def _features(gains: list[int]) -> list[float]:
    g = np.array(gains, dtype=np.int64)
    near, far = int((g >= NEAR).sum()), int((g >= FAR).sum())
    return [1.0, math.log1p(near), math.log1p(far), math.log((far + 0.1) / (len(g) + 10))]


def _score(features: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ np.array(weights), -30, 30)))


def _segments(word: str) -> set[str]:
    w = f" {word} "
    return {w} | {w[:n] for n in range(5, min(9, len(w)))} | {w[-n:] for n in range(5, min(9, len(w)))}


def _family(found: list[str]) -> int:
    return min((zlib.crc32(" ".join(found[i:i + 5]).encode()) for i in range(max(1, len(found) - 4))), default=0)


def train_dictionaries(texts: list[str], labels: list[int], size: int = 24_000, common: int = 1500) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents from labelled texts."""
    holders, frequent, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    families = defaultdict(list)
    for i, (text, y) in enumerate(zip(texts, labels)):
        families[y, _family(windows(text))].append(i)
    for (y, _), members in families.items():  # a family counts once for each of its segments
        own: set[str] = set()
        for i in members:
            found = set(windows(texts[i]))
            frequent[y].update(found)
            own |= found
        holders[y].update(set().union(*map(_segments, own)) if own else ())
        n[y] += 1
    ranked = lambda c: sorted(c, key=lambda w: (-c[w], w))
    usual = ranked(frequent[0])[:common]

    def telling(y: int) -> list[str]:
        def surprise(a: int, b: int) -> float:
            """Likelihood ratio of a families of this class and b of the other against chance."""
            even = (a + b) * np.array([n[y], n[1 - y]]) / (n[0] + n[1])
            return 2 * sum(k * math.log(k / e) for k, e in zip((a, b), even) if k)

        chosen = set()
        for s, a in holders[y].items():
            b = holders[1 - y][s]
            # 20: by chance one segment in 10^5
            if (a + 0.5) * (n[1 - y] + 1) >= 8 * (b + 0.5) * (n[y] + 1) and surprise(a, b) >= 20:
                chosen.add(s)
        out, used = [], 0
        for w in ranked(frequent[y]):
            if chosen & _segments(w):
                used += len(w.encode()) + 1
                if used > size:
                    break
                out.append(w)
        return out

    toxic, ordinary = telling(1), telling(0)
    both = [w for w in usual if w not in set(toxic)]
    content = lambda words: (" " + " ".join(reversed(words)) + " " + "\0" * 16).encode()
    return content(toxic + both), content(ordinary + both)


def fit(train: list[tuple[str, int]], calibrate: list[tuple[str, int]], prior: float) -> Model:
    """The model from (text, label) rows; ``prior`` is the share of toxic ones among all labels."""
    toxic, ordinary = train_dictionaries([t for t, _ in train], [y for _, y in train])
    y = np.array([label for _, label in calibrate], dtype=float)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not 0 < y.sum() < len(y):
        return Model(toxic, ordinary, (math.log(prior / (1 - prior)), 0.0, 0.0, 0.0))
    distance = Distance(toxic, ordinary)
    x = np.array([_features(distance(windows(t))) for t, _ in calibrate])
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum())) * len(y)
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(50):
        p = _score(x, b)
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        b = b + np.linalg.solve(slope, x.T @ (weight * (y - p)) - ridge @ b)
    return Model(toxic, ordinary, tuple(float(v) for v in b))


def fold(key: Column) -> Column:
    """crc32 of the id's text, modulo 4 (a null id: of the empty string)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out: int = 2, per_class: int = 1500) -> Model:
    """A model from the labelled documents outside fold ``held_out``: folds 0 and 1 (those
    that are not held out) make the dictionaries, the remaining one the calibration.

    Labels other than 0 and 1, and null ids, take no part; of several labels of one id
    the largest counts. Without labels of both kinds the model scores the prior."""
    known = (labels.where(F.col(key_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col(key_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
             .withColumn("_fold", fold(F.col("_id"))).where(F.col("_fold") != held_out))
    last = 3 if held_out != 3 else 2
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    ids = []
    for y in (0, 1):
        for calibrating, most in ((False, per_class), (True, per_class // 2)):
            part = known.where((F.col("_y") == y) & ((F.col("_fold") == last) == F.lit(calibrating)))
            ids += [(r["_id"], y, calibrating) for r in part.orderBy(F.md5(F.col("_id").cast("string")), "_id")
                    .limit(most).select("_id").collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "_id long, _y int, _calibrating boolean")
    rows = (docs.select(F.col(key_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .join(F.broadcast(chosen), "_id")  # at most 3 x per_class ids
            .dropDuplicates(["_id"]).collect())
    rows.sort(key=lambda r: r["_id"])
    part = lambda c: [(r["_text"] or "", r["_y"]) for r in rows if r["_calibrating"] == c]
    return fit(part(False), part(True), prior)


def _scorer(model: Model, text_at: int, with_text: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key = store("toxicity"), model.key()
        if key not in known:
            known.clear()
            known[key] = Distance(model.toxic, model.ordinary)
        distance = known[key]
        for batch in slices(batches):
            out = [_features(distance(windows(t or ""))) for t in batch.column(text_at).to_pylist()]
            values = _score(np.array(out).reshape(-1, 4), model.weights)
            if not with_text:
                batch = batch.remove_column(text_at)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(values, pa.float64())],
                                             names=batch.schema.names + ["score"])

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` (or all but its text) plus ``score`` (0 to 1; an existing column of that name
    is replaced). A null or empty text has no window and gets the score of none."""
    docs = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c)
                         for c in docs.columns if c != "score" or c == text_col])
    kept = [(c, t) for c, t in docs.dtypes if with_text or c != text_col]
    schema = ", ".join([f"`{c}` {t}" for c, t in kept] + ["score double"])
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), with_text), schema)
