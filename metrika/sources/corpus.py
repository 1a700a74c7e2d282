"""Texts from tables, files and saved data sets; saving, resuming and error isolation."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch


def from_strings(spark: SparkSession, texts: list[str], lang: str | None = None) -> DataFrame:
    """text_id, text, lang from strings; an error if there are none."""
    if not texts:
        raise ValueError("no text given")
    return spark.createDataFrame([(str(k), t, lang) for k, t in enumerate(texts)], "text_id string, text string, lang string")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One text per file: text_id is the path, lang the file name's first part (`en.name.txt`), the text trimmed."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return rows.select(
        F.input_file_name().alias("text_id"),
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"),
        F.regexp_extract(name, r"^([a-z]{2})\.", 1).alias("lang"),
    )


def listing(texts: DataFrame) -> DataFrame:
    """text_id, lang, n_lines (non-blank)."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return texts.select("text_id", "lang", lines.alias("n_lines"))


def safe_path(root: str, name: str) -> str:
    """`name` below `root`; an error if it leads outside."""
    found = posixpath.normpath(posixpath.join(root, name))
    if not found.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"outside of the corpus: {name}")
    return found


def items(rows: DataFrame, id_column: str = "id") -> DataFrame:
    """text_id and text of items whose text is in `text` or `txt`."""
    have = [c for c in ("text", "txt") if c in rows.columns]
    if not have:
        raise ValueError("items need a column text or txt")
    return rows.select(F.col(id_column).alias("text_id"), F.coalesce(*have).alias("text"))


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The items whose text_id is not done yet."""
    return rows.join(done.select("text_id").distinct(), "text_id", "left_anti")


def status(text: Column) -> Column:
    """'ok', or what is wrong with a text."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty").when(~text.rlike(r"\p{L}"), "no words").otherwise("ok")
    )


def with_status(rows: DataFrame, on_error: str = "log") -> DataFrame:
    """Adds status; with on_error='raise' a bad item raises when it is read."""
    found = status(F.col("text"))
    if on_error == "raise":
        found = F.when(found == "ok", found).otherwise(F.raise_error(F.concat(F.lit("bad item: "), found)))
    return rows.withColumn("status", found)


def save(rows: DataFrame, path: str, meta: dict | None = None, partition: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet (gzip) under path/data and one JSON row of metadata under path/meta."""
    writer = rows.write.mode(mode).option("compression", "gzip")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/data")
    text = json.dumps({"columns": rows.columns, **(meta or {})}, sort_keys=True)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What `save` has written: the rows and the metadata."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return spark.read.parquet(f"{path}/data").select(meta["columns"]), meta


def round_trip(rows: DataFrame) -> DataFrame:
    """Rows saved in a new folder of the shared scratch folder and read back."""
    spark = rows.sparkSession
    path = scratch.new_path(spark, "round-trip")
    save(rows, path)
    return load(spark, path)[0]


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """text, scansion, frequency from a tab-separated file whose columns may go by other names; frequency is 1 where absent."""
    rows = spark.read.csv(path, sep="\t", header=True)
    lower = {c.lower().strip(): c for c in rows.columns}
    pick = lambda *names: next((F.col(f"`{lower[n]}`") for n in names if n in lower), None)
    text, scansion = pick("text", "txt", "line"), pick("scansion", "parse", "meter")
    if text is None or scansion is None:
        raise ValueError("annotations need a text and a scansion column")
    frequency = pick("frequency", "freq", "count")
    frequency = F.lit(1.0) if frequency is None else F.coalesce(frequency.try_cast("double"), F.lit(1.0))
    return rows.select(text.alias("text"), scansion.alias("scansion"), frequency.alias("frequency"))


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Write rows as csv, tsv or json."""
    if kind == "json":
        rows.write.json(path)
    elif kind in ("csv", "tsv"):
        rows.write.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        raise ValueError(f"unknown kind: {kind}")
