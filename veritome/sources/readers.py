"""Scans of landed files: documents, feeds, JSON lines, CSV with money, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

__all__ = ["aliases", "case_from_path", "csv_money", "docket_stage", "documents", "feed_entries", "json_any", "json_lines", "partitioned", "query_chunks", "stages"]


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, text, path`` of every text file below a folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def feed_entries(spark: SparkSession, root: str) -> DataFrame:
    """``text, speaker, link`` of feed entries: title, summary and content, the feed's name as speaker."""
    schema = "id string, title string, summary string, content string, link string"
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    parts = [F.when(F.trim(c) != "", F.trim(c)) for c in ("title", "summary", "content")]
    speaker = F.upper(F.regexp_extract("_metadata.file_path", r"/rss/([^/]+)/", 1))
    return df.select(F.coalesce("id", "link").alias("id"), F.concat_ws(" ", *parts).alias("text"), speaker.alias("speaker"), "link")


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with only the columns asked for (S3, S4, S7, S13); bad lines fail when strict, else they are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array, or JSON lines.

    A file's content is told by its first character; each kind is read by the reader made for it.
    """
    head = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
    kinds = head.select("path", F.trim(F.decode(F.substring("content", 1, 64), "UTF-8")).startswith("[").alias("array"))
    rows = kinds.collect()  # one row a file
    arrays, lines = [r["path"] for r in rows if r["array"]], [r["path"] for r in rows if not r["array"]]
    out = None
    for files, multi in ((arrays, "true"), (lines, "false")):
        if files:
            df = spark.read.schema(schema).option("multiLine", multi).option("mode", "DROPMALFORMED").json(files)
            out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def csv_money(spark: SparkSession, path: str, money: list[str]) -> DataFrame:
    """A CSV with header whose money columns hold separators or the word null, which is 0."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    for c in money:
        v = F.regexp_replace(F.trim(c), r"[,$]", "")
        df = df.withColumn(c, F.when(F.lower(v) == "null", 0.0).otherwise(v.try_cast("double")))
    return df.dropna(subset=money)


def aliases(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """``alias``: all names in some columns of a CSV, in lower case."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.explode(F.array(*cols)).alias("alias")).select(F.lower(F.trim("alias")).alias("alias")).filter("alias <> ''").distinct()


def stages(spark: SparkSession, root: str) -> DataFrame:
    """``path, stage`` of the files whose name ends in _stageN."""
    df = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).select("path")
    n = F.regexp_extract("path", r"_stage(\d+)\.[a-z]+$", 1)
    return df.select("path", F.nullif(n, F.lit("")).cast("int").alias("stage")).filter("stage IS NOT NULL")


def docket_stage(spark: SparkSession, root: str, schema: str = "text string") -> DataFrame:
    """Stage-1 documents of dockets with case and entry number from their path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "doc_*_stage1.jsonl").json(root)
    path = F.col("_metadata.file_path")
    entry = F.nullif(F.regexp_extract(path, r"entry_(\d+)_documents", 1), F.lit("")).cast("int")
    return df.select("*", case_from_path(path).alias("case_id"), entry.alias("entry_id"), path.alias("path"))


def partitioned(spark: SparkSession, path: str, **values) -> DataFrame:
    """A table laid out by fold, split or stage, pruned to the values asked for."""
    df = spark.read.parquet(path)
    for c, v in values.items():
        df = df.filter(F.col(c) == v)
    return df


def case_from_path(path: Column) -> Column:
    """The case in a path: the folder above entries, else unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/(\d[^/]*?_\w+|\d[^/]*)/entries/", 1), F.lit("")), F.lit("unknown"))


def query_chunks(names: DataFrame, col: str, size: int = 10) -> DataFrame:
    """``chunk, terms``: names in order, joined by OR in groups."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.orderBy(col))
    rows = names.select(col).distinct().withColumn("chunk", F.floor((rn - 1) / size))
    return rows.groupBy("chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(col)), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("terms"))
