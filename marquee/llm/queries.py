"""The registered queries of the training-data operators: one per operator, over
its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.sources.tables import read_table

#: name -> (callable, oracle SQL or None)
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTERED[name] = (fn, sql)
        return fn
    return deco


@_register("op1_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best inner products of every 20th embedding against all the others."""
    from marquee.llm import topk
    vectors = topk.quantise(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file (the operators take any path)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_register("op7_token_store")
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into binary shards, then found again through the
    index by its key; start, length and CRC-32 as read from the files."""
    from marquee.llm import token_store
    from marquee.session import scratch_path
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = token_store.write(docs, scratch_path(spark, "tokens"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    stored = token_store.digests(spark, path)
    same_key = Window.partitionBy("key").orderBy(F.lit(1))
    keys = docs.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").select(
        "key", (F.row_number().over(same_key) - 1).alias("copy"))
    places = token_store.lookup(keys, path)
    by_key = places.join(stored.drop("n", "key"), ["part", "seq", "offset"]).select("key", "start", "n", "crc")
    without = stored.where("key IS NULL").select("key", "start", "n", "crc")
    return by_key.unionByName(without).select(
        F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@_register("op2_bestfit_packing")
def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens and their place in a sequence."""
    from marquee.llm import packing
    from marquee.session import written
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    cut = written(packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, with_ids=False), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_register("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level BPE ranks and decoded again."""
    import public_tokenizers

    from marquee.llm import bpe
    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern)
    return bpe.digests(encoded, ranks, pattern).withColumnRenamed("key", "doc_id")


#: Shards of the placement query; their number is the only thing the data does not give.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


@_register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to its shard's folder and read back from there."""
    from marquee.llm import sharding
    from marquee.session import scratch_path
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = sharding.write_shards(docs, scratch_path(spark, "shards"), SHARDS)
    stored = sharding.read_shards(spark, path, "doc_id long, text string, slot long, shard string")
    return stored.select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@_register("op10_line_dedup", """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d
), f AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM l WHERE translate(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '') <> ''
), w AS (
  SELECT a.doc_id, a.j, a.line AS l1, b.line AS l2, c.line AS l3
  FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.j = a.j + 1 JOIN f c ON c.doc_id = a.doc_id AND c.j = a.j + 2
), later AS (
  SELECT doc_id, j FROM (
    SELECT doc_id, j, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, j) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM later JOIN f ON f.doc_id = later.doc_id AND f.j BETWEEN later.j AND later.j + 2
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text,
         count(*) AS n_lines, count(gone.i) AS n_removed
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line passages."""
    from marquee.llm import line_dedup
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    kept = line_dedup.remove_repeats(docs)
    return kept.select("doc_id", F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.col("n_lines")).cast("long")
                       .alias("n_lines"), "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@_register("op4_minhash_neardup")
def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates (2-word shingles, similarity 0.8) of every document."""
    from marquee.llm import minhash
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.near_duplicates(docs, width=2, percent=80).withColumnRenamed("key", "doc_id")


@_register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a repeated 200-byte string covers."""
    from marquee.llm import suffix_dedup
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.remove_repeats(docs, length=200, with_text=False)


@_register("op5_quality_mcd")
def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the robust outlier verdict of every document."""
    from marquee.llm import quality
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed", "kept", "distance")


@_register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by dictionaries of labelled ones outside the held-out fold."""
    from marquee.llm import toxicity
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model, with_text=False)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds unrolled: a(r) assigns every vector to the centroids c(r), c(r+1) are its floored means."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT rid, unnest(w) AS x, unnest(range(64)) AS i FROM v
), c0 AS MATERIALIZED (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, w) - 1 AS c, w FROM v)
  WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, c, d FROM (
    SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS n FROM (
      SELECT v.rid, c{r}.c, CAST(list_sum(list_transform(list_zip(v.w, c{r}.w),
             lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r})) WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS w FROM (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT a{r}.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY 1, 2)) GROUP BY c
  UNION ALL SELECT c, w FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return "WITH " + ", ".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.c = a.c"""


@_register("op13_dimension_lloyd", _lloyd_sql())
def op13_dimension_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every 64-component embedding after three rounds of Lloyd."""
    from hashlib import sha256

    from marquee.llm import lloyd
    vectors = lloyd.quantised(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)
    found = lloyd.lloyd(vectors, 64, k=16, rounds=3, seed=1)
    totals = found.totals
    names = spark.createDataFrame([(i, sha256(",".join(map(str, c)).encode()).hexdigest())
                                   for i, c in enumerate(found.centroids.tolist())], "cluster int, centroid_sha256 string")
    whole = totals.agg(F.sum("inertia").alias("inertia"))
    clusters = (totals.withColumnRenamed("inertia", "cluster_inertia").join(F.broadcast(names), "cluster")
                .join(F.broadcast(whole), how="inner", on=F.lit(True)))  # at most k rows
    return found.assigned.join(F.broadcast(clusters), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@_register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words and more of every document (a tenth of them made periodic first), the
    longest one, and digests of all of them and of the text without their repeats."""
    from marquee.llm import runs
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("seed", F.when(h % 10 == 0, F.floor(h / 10)))
    found = runs.periodic_runs(docs, min_length=12, seed_col="seed")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("flip"))))
    found = found.withColumn("best", best)
    return found.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.flip")).alias("period"),
        F.expr("(1000 * best.length) div (-best.flip)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@_register("op11_signature_join")
def op11_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of linked documents (3-word shingles, similarity 0.9) of every document."""
    from marquee.llm import signature_trees
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return signature_trees.linked_classes(docs, width=3, percent=90).withColumnRenamed("key", "doc_id")
