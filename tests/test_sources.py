import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.sources import files as S
from marquee.streaming.registry_stream import start_registry_stream


def test_lenient_csv_bad_bytes_quoted_newline_short_rows(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "movies.csv")
    with open(path, "wb") as fh:
        fh.write(b"id,title,vote_average\n")
        fh.write(b'1,"Multi\nline",7.5\n')
        fh.write(b"2,Caf\xe9 bad byte,6.0\n")
        fh.write(b"3,short\n")
    df = S.read_csv_lenient(spark, path, ["id", "title", "vote_average"]).orderBy("id").collect()
    assert df[0]["title"] == "Multi\nline"
    assert "�" in df[1]["title"]
    assert df[2]["vote_average"] is None and df[2][S.CORRUPT] is not None


def test_typed_pruned_csv_listing_failure_log_and_sink(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "links.csv")
    with open(path, "w") as fh:
        fh.write("movieId,imdbId,tmdbId\n1,0114709,862\n2,12345678,\n")
    schema = T.StructType([T.StructField("movieId", T.LongType()), T.StructField("imdbId", T.StringType()),
                           T.StructField("tmdbId", T.LongType())])
    links = S.read_csv_typed(spark, path, schema, ["imdbId", "tmdbId"])
    assert links.columns == ["imdbId", "tmdbId"] and links.where("tmdbId IS NULL").count() == 1
    posters = os.path.join(tmpdir_run, "posters")
    os.makedirs(posters)
    for name in ("tt0114709.jpg", "tt1.png"):
        open(os.path.join(posters, name), "wb").write(b"x")
    assert [r["file"] for r in S.list_files(spark, posters).collect()] == ["tt0114709.jpg"]
    log = os.path.join(tmpdir_run, "fail.log")
    open(log, "w").write("tt0114709.jpg\tHTTP 404\n\ntt7\tno match\n")
    assert sorted(r["key"] for r in S.read_failure_log(spark, log).collect()) == ["0114709", "7"]
    out = os.path.join(tmpdir_run, "out")
    S.write_table(links, out, "csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2
    S.save_model({"items": links}, os.path.join(tmpdir_run, "model"))
    m = S.load_model(spark, os.path.join(tmpdir_run, "model"), ["items"])
    assert m["items"].count() == 2


def test_nested_names_and_credits(spark):
    df = spark.createDataFrame([("[{'id': 1, 'name': 'Drama'}, {'id': 2, 'name': None}]",), ("junk",), (None,)],
                               "g string")
    got = [r[0] for r in df.select(S.parse_nested_names("g")).collect()]
    assert got[0] == ["Drama", None] and got[1] == [] and got[2] == []
    cr = spark.createDataFrame([("[{'name': 'A'}, {'name': 'B'}]", "[{'job': 'Writer', 'name': 'W'}, {'job': 'Director', 'name': 'D'}]")],
                               "cast string, crew string")
    r = cr.select(*S.parse_credits("cast", "crew")).first()
    assert r["director"] == "D" and r["top_cast"] == "A|B"


def test_registry_stream_last_wins(spark, tmpdir_run):
    src = os.path.join(tmpdir_run, "updates")
    schema = "imdb_id string, poster_url string, seq int"
    spark.createDataFrame([("tt1", "u1", 0), ("tt2", "error", 0), ("tt1", "u2", 1)], schema) \
        .write.parquet(os.path.join(src, "b0"))
    q = start_registry_stream(spark, src + "/*", T._parse_datatype_string(schema),
                              os.path.join(tmpdir_run, "reg"), os.path.join(tmpdir_run, "ckpt"))
    q.awaitTermination(120)
    reg = spark.read.parquet(os.path.join(tmpdir_run, "reg", "v0"))
    assert {r["imdb_id"]: r["poster_url"] for r in reg.collect()} == {"tt1": "u2", "tt2": "error"}


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
