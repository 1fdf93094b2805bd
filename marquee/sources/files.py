"""File sources and sinks: lenient CSV, typed pruned CSV, file listings,
failure logs, nested-literal parsing, table sinks and model persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# raw catalog columns, all read as text and typed later
RAW_CATALOG_COLUMNS = (
    "budget", "id", "original_language", "overview", "popularity", "release_date", "revenue",
    "runtime", "status", "title", "vote_average", "vote_count", "genres_parsed", "countries",
    "director", "top_cast", "keywords_parsed",
)


def string_schema(columns: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def read_csv_lenient(spark: SparkSession, path: str, columns: Sequence[str] = RAW_CATALOG_COLUMNS) -> DataFrame:
    """Header CSV, quoted newlines kept, bad UTF-8 bytes -> U+FFFD, short
    or long rows kept with the raw line in ``_corrupt_record``."""
    return (spark.read.schema(string_schema(columns))
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("encoding", "UTF-8")
            .csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Explicit schema, only the named columns survive (the reader prunes)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """S3: names of the files under ``path`` matching ``glob`` (existence set);
    only the path column is read, never the file contents."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path).select("path"))
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).distinct()


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    """First tab-separated field of each line, ``tt`` prefix and ``.jpg``
    suffix stripped."""
    first = F.split(F.col("value"), "\t").getItem(0)
    key = F.regexp_replace(F.regexp_replace(F.trim(first), r"^tt", ""), r"\.jpg$", "")
    return spark.read.text(path).select(key.alias("key")).where(F.col("key") != "")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table (parquet by default, CSV with header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def parse_nested_names(c, field: str = "name") -> F.Column:
    """A list-of-dict literal (JSON or Python style) -> array of ``field``;
    unparsable input -> empty array."""
    txt = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\bNone\b", "null")
    parsed = F.from_json(txt, f"array<struct<id:long,{field}:string>>", {"allowSingleQuotes": "true"})
    return F.coalesce(F.transform(parsed, lambda s: s[field]), F.array().cast("array<string>"))


def parse_credits(cast_col: str, crew_col: str, k: int = 5) -> list[F.Column]:
    """Director (first crew entry with job Director) and the first k cast
    names joined by '|'."""
    crew = F.from_json(F.col(crew_col), "array<struct<job:string,name:string>>",
                       {"allowSingleQuotes": "true"})
    cast = F.from_json(F.col(cast_col), "array<struct<name:string>>", {"allowSingleQuotes": "true"})
    director = F.get(F.filter(crew, lambda x: x["job"] == "Director"), 0)["name"]
    top = F.array_join(F.slice(F.transform(cast, lambda x: x["name"]), 1, k), "|")
    return [director.alias("director"), top.alias("top_cast")]


def save_model(factors: dict[str, DataFrame], path: str) -> None:
    """Persist factor / similarity tables as parquet folders."""
    for name, df in factors.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
