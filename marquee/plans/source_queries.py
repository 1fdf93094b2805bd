"""Registered queries of the file sources and sinks (S1-S5, S7, S11, P20): each writes
given tables to the shared folder in the source's format and reads them back through it;
the oracle is the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.common import r6
from marquee.operators import clean as C
from marquee.plans.registry import register
from marquee.session import scratch_path
from marquee.sources import files as S
from marquee.sources.tables import read_table

_CSV = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]


@register("lenient_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '"' || c_mktsegment AS c_name, c_mktsegment,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""")
def q_lenient_csv(spark, d):
    """Text columns with quotes and line breaks inside."""
    path = scratch_path(spark, "lenient")
    t = read_table(spark, d, "customer", *_CSV).withColumn(
        "c_name", F.concat("c_name", F.lit('\n"'), "c_mktsegment"))
    t.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return S.read_csv_lenient(spark, path, _CSV).select(*_CSV)


@register("typed_csv", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer")
def q_typed_csv(spark, d):
    """A CSV sink read back with a schema, two columns of four."""
    path = scratch_path(spark, "typed")
    S.write_table(read_table(spark, d, "customer", *_CSV), path, "csv")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                           T.StructField("c_mktsegment", T.StringType()), T.StructField("c_nationkey", T.LongType())])
    return S.read_csv_typed(spark, path, schema, ["c_custkey", "c_mktsegment"])


@register("file_listing", "SELECT DISTINCT lower(c_mktsegment) AS folder FROM customer")
def q_file_listing(spark, d):
    """S3: one file in a folder per segment; the listing tells which folders have one."""
    path = scratch_path(spark, "listing")
    names = read_table(spark, d, "customer", "c_mktsegment").distinct().select(F.lower("c_mktsegment").alias("folder"))
    names.withColumn("value", F.col("folder")).repartition("folder").write.partitionBy("folder").text(path)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True)
             .load(path).select("path"))
    listed = S.list_files(spark, path, "*.txt")
    kept = files.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).join(listed, "file", "left_semi")
    return kept.select(F.url_decode(F.regexp_extract("path", r"folder=([^/]+)/", 1)).alias("folder")).distinct()


@register("failure_log", """
SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F'""")
def q_failure_log(spark, d):
    """A tab-separated log of asset names; the keys out of it."""
    path = scratch_path(spark, "log")
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'")
    o.select(F.concat(F.lit("tt"), F.col("o_orderkey").cast("string"), F.lit(".jpg\tHTTP 404\t"), "o_orderstatus")).write.text(path)
    return S.read_failure_log(spark, path)


@register("table_sink", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders""")
def q_table_sink(spark, d):
    """A partitioned Parquet sink."""
    path = scratch_path(spark, "sink")
    S.write_table(read_table(spark, d, "orders", "o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.schema("o_orderkey long, o_orderstatus string").parquet(path)


@register("credits_parse", """
SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS director,
       c_name || '|' || c_mktsegment || '|a|b|c' AS top_cast FROM customer""")
def q_credits_parse(spark, d):
    """Director and the first five of six cast names out of credits literals."""
    t = read_table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    names = [F.col("c_name"), F.col("c_mktsegment"), *[F.lit(x) for x in "abcd"]]
    cast = F.to_json(F.array(*[F.struct(n.alias("name")) for n in names]))
    crew = F.to_json(F.array(*[F.struct(F.lit(j).alias("job"), F.col(c).alias("name")) for j, c in
                               (("Writer", "c_mktsegment"), ("Director", "c_name"), ("Director", "c_mktsegment"))]))
    t = t.withColumn("cast", cast).withColumn("crew", crew)
    return t.select(F.col("c_custkey").cast("bigint").alias("id"), *S.parse_credits("cast", "crew"))


@register("model_store", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""")
def q_model_store(spark, d):
    """Vectors saved and loaded as a model table."""
    path = scratch_path(spark, "model")
    S.save_model({"vectors": read_table(spark, d, "embeddings", "vec_id", "embedding")}, path)
    v = S.load_model(spark, path, ["vectors"])["vectors"]
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return v.select(F.col("vec_id").cast("bigint").alias("vec_id"), r6(total).alias("total"))


@register("epoch_ratings", """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(year(o_orderdate) AS INTEGER) AS rating_year,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts FROM orders""")
def q_epoch_ratings(spark, d):
    """P20: epoch seconds to timestamp and year."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    o = o.select(F.col("o_orderkey").cast("bigint").alias("id"),
                 F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"))
    return C.epoch_to_timestamp(o).select("id", "rating_year", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
