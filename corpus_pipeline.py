"""A training corpus from raw documents, stage by stage.

Each stage takes all that its predecessor kept, as ``(spark, docs, sf_dir)``, and returns
the columns of ``documents`` (the last one: packed pieces); in between, the rows are
written as Parquet to the shared folder and read again.

1. ``toxicity``: documents scored 0.3 or more go.
2. ``line_dedup``: later occurrences of three-line passages go; a document that loses all
   it had goes too.
3. ``near_duplicates``: of every group of rows linked by five-word shingles (similarity 0.8
   and more) one row stays, the one with the smallest id (null last), of rows alike in id the
   one with the smallest text hash; repeated rows are a group too. Rows without words all stay.
4. ``suffix_dedup``: bytes that a repeated 200-byte string covers go, but for characters
   they only touch; a document that loses all it had goes too.
5. ``packing``: what is left is tokenized and packed into sequences of 4096.

``n_chars`` follows the text. Null texts count as empty and stay rows (of the last stage:
one piece of the end id) unless a rule above drops them; null ids are kept. Other columns of the
input are dropped; missing ``labels`` of a kind leave every document with the prior score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import line_dedup, minhash, packing, suffix_dedup
from marquee.llm import toxicity as tox
from marquee.llm.queries import tokenizer_file
from marquee.session import configure, written
from marquee.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` as the text now is."""
    length = F.length("text").cast("long")
    return df.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = tox.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _documents(tox.score(docs.select(*COLUMNS), model).where(F.col("score") < 0.3))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    kept = line_dedup.remove_repeats(docs.select(*COLUMNS))
    return _documents(kept.where((F.col("n_removed") == 0) | (F.translate("text", " \t\n\x0b\x0c\r", "") != "")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return _documents(minhash.one_of_each(docs.select(*COLUMNS), width=5, percent=80))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=200)
    return _documents(cut.where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
                      .withColumnRenamed("kept_text", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut = written(packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, with_ids=False), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates),
          ("suffix_dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: No SQL has a trained classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTERED = {"pipeline": (run, ORACLE_SQL)}
