"""Parquet, CSV and JSON tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import nan_to_null

EPISODE = "id string, name string, period struct<start:int,peak:int,end:int>, peak_date string, category string, severity int, max_drawdown int, outcome string, tickers array<string>, market string, is_bubble boolean, is_target boolean"
DAILY = "permno int, date date, ret double, price double, shrout double"
FUNDAMENTALS = "gvkey string, datadate date, total_debt double, total_assets double, shares_outstanding double"
BONDS = "date date, cusip string, issuer_cusip string, t_spread double, tmt double, rating_num int, rating_cat string, amount_outstanding double"
FILING_INDEX = "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>>>"
OLDER_INDEX = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet file or folder; partition folders become columns. NaN becomes NULL."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.parquet(path))


def read_named_files(spark: SparkSession, glob: str, key: str = "episode_id") -> DataFrame:
    """Many Parquet files with the file name as a key column."""
    return nan_to_null(spark.read.parquet(glob)).withColumn(key, F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet", 1))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def read_texts(spark: SparkSession, path: str, index: DataFrame, key: str) -> DataFrame:
    """(key, text) of the text files that the index names and that exist; the key is the file's name without its ending."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias(key), F.col("value").alias("text"))
    return files.join(index.select(key).distinct(), key, "left_semi")


def scan_keys(facts: DataFrame, keys: DataFrame, key: str, date: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The facts of the given keys within the dates: a filter that reaches the scan, and a semi join in place of key lists."""
    if date and start:
        facts = facts.where(F.col(date) >= F.to_date(F.lit(start)))
    if date and end:
        facts = facts.where(F.col(date) <= F.to_date(F.lit(end)))
    return facts.join(keys.select(key).distinct(), key, "left_semi")


def filing_rows(raw: DataFrame, json: str, keep: Sequence[str], schema: str = FILING_INDEX, at: str = "filings.recent") -> DataFrame:
    """A row for each filing of columnar JSON: arrays of forms, dates, numbers and documents side by side."""
    parsed = raw.withColumn("_j", F.from_json(json, schema))
    block = f"_j.{at}" if at else "_j"
    zipped = F.arrays_zip(*[F.col(f"{block}.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    return parsed.select(*keep, F.inline(zipped))


def filing_index(rows: DataFrame, forms: Sequence[str], start: str, end: str, cik: str = "cik") -> DataFrame:
    """Filings of the forms within the dates, one per (cik, accession)."""
    kept = rows.where(F.col("form").isin(*forms) & F.col("filingDate").between(start, end))
    return kept.withColumn("accession", F.regexp_replace("accessionNumber", "-", "")).dropDuplicates([cik, "accessionNumber"])


def ticker_map(raw: DataFrame, json: str) -> DataFrame:
    """(ticker, cik) of a JSON object of objects; cik with ten digits."""
    entries = raw.select(F.explode(F.map_values(F.from_json(json, "map<string,struct<ticker:string,cik_str:string>>"))).alias("e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), F.lpad("e.cik_str", 10, "0").alias("cik"))


def catalog(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EPISODE)


def bubbles(cat: DataFrame) -> DataFrame:
    return cat.where("is_bubble AND NOT coalesce(is_target, false)")


def near_bubbles(cat: DataFrame) -> DataFrame:
    return cat.where("NOT is_bubble AND NOT coalesce(is_target, false)")


def target_episodes(cat: DataFrame) -> DataFrame:
    return cat.where("is_target")


def membership(cat: DataFrame) -> DataFrame:
    return cat.select(F.col("id").alias("episode_id"), F.explode("tickers").alias("ticker"))


def write_stage(df: DataFrame, path: str, by: str = "episode_id") -> None:
    """Parquet with a folder per group."""
    df.repartition(by).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_firm_lists(cat: DataFrame, path: str) -> None:
    membership(cat).repartition("episode_id").write.mode("overwrite").partitionBy("episode_id").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
