"""Sources and sinks: JSON lines, whole documents, delimited text, manifests and guarded writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.hashing import bucket, order_key
from lodestream.functions.text import stripped


def json_lines(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """Non-blank JSON lines. Strict reading fails on a malformed line, otherwise such lines are skipped."""
    r = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return (r.schema(schema) if schema else r).json(path)


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, raw, valid`` of every non-blank line; lines that hold no JSON object stay, with valid false."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    return x.withColumn("valid", F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one JSON value; a top-level list gives a row an item."""
    return spark.read.option("multiLine", "true").json(path)


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited text with given column names and no header."""
    return spark.read.option("sep", sep).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, raw, valid`` of every non-blank line; lines are numbered from 1 within their file, blank ones counted.

    A file is read as one row and split there, so a file must fit into one task.
    """
    x = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    x = x.where(F.trim("raw") != "").withColumn("line", F.col("line") + 1)
    return x.withColumn("valid", F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{"))


def object_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file that holds one JSON list of objects; anything else is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.trim("value").alias("t")).first()
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("i")) if whole and whole["v"] is not None and whole["t"].startswith("[") else None
    if items is None or items.where(~F.coalesce(F.col("i").startswith("{"), F.lit(False))).limit(1).count():
        raise ValueError(f"expected a list of objects: {path}")
    return json_document(spark, path)


def tables(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(union by name of the parquet tables that exist, paths that do not)."""
    found, gone = [], []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        (found if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else gone).append(path)
    return (aligned([spark.read.parquet(x) for x in found]) if found else None), gone


def with_fallback_split(df: DataFrame, validation: DataFrame | None, key: str, percent: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the given validation rows, or without any the share ``percent`` of ``df`` by hash of the key. Null keys train."""
    if validation is not None and validation.limit(1).count():
        return df, validation
    held = F.coalesce(bucket(F.col(key).cast("string"), seed) < percent, F.lit(False))
    return df.where(~held), df.where(held)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: non-blank lines without outer white space."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("line")).where("line <> ''")


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``word, frequency`` of lines that begin with a word and a whole number; a word without a number has 0, the largest number of a word counts."""
    x = text_lines(spark, path).select(F.split("line", r"\s+").alias("p"))
    x = x.select(F.col("p")[0].alias("word"), F.coalesce(F.try_element_at("p", F.lit(2)).try_cast("bigint"), F.lit(0)).alias("frequency"))
    return x.groupBy("word").agg(F.max("frequency").alias("frequency"))


def key_values(lines: list[str]) -> dict[str, str]:
    """Settings of lines KEY=VALUE, the first of a key; blank lines, comments, a leading export and one pair of quotes are dropped."""
    out: dict[str, str] = {}
    for line in lines:
        key, found, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not found or not key.replace("_", "a").isalnum() or key.startswith("#") or key[0].isdigit():
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out.setdefault(key, value)
    return out


def aligned(frames: list[DataFrame]) -> DataFrame:
    """Union of frames by name; missing columns are null, in the order first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and give the number of rows written, counted in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return int(seen.get["rows"])


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV file with a header for spreadsheets: small reports only, as it is written by one task; ``bom`` marks it as UTF-8."""
    names = df.columns
    mark = "\ufeff" if bom else ""
    df.coalesce(1).select(*[F.col(c).alias(mark + c if i == 0 else c) for i, c in enumerate(names)]).write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)


def write_stats(spark: SparkSession, path: str, stats: dict) -> None:
    """A statistics record as one JSON text file, keys in their order, indented."""
    text = json.dumps(stats, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(df: DataFrame, path: str, key: str, seed: int = 42) -> None:
    """JSON lines sorted by the hash order of ``key`` over all files, so that a manifest reads the same each time."""
    df.withColumn("_k", order_key(F.col(key), seed)).orderBy("_k", key).drop("_k").write.mode("overwrite").json(path)


def write_routed(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """One pass into a folder for each value of the routing columns, such as status and split."""
    df.write.mode(mode).partitionBy(*columns).json(path)


def write_if(df: DataFrame, path: str, ready: bool) -> bool:
    """Overwrite ``path`` only if ``ready``."""
    if ready:
        df.write.mode("overwrite").json(path)
    return ready


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of files, each hashed whole."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
