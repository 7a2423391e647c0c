"""File sources and sinks: JSON tables and documents, tolerant rule files, CSV of unknown encoding, pages, images."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """A table of JSON objects: arrays of them or one a line. No inference pass; fields that a file lacks are null."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """The table, or no rows where the path doesn't exist."""
    try:
        return read_json(spark, path, schema, multiline)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files with headers; null is written as an empty text."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_csv_sniffed(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("euc-kr", "cp949", "utf-8-sig", "utf-8")) -> DataFrame:
    """file and one row for each CSV record as a map by header; each file is decoded by the first encoding that fits it.

    A file is read whole by one task, as its encoding is that of all its bytes.
    """

    @F.arrow_udf("array<map<string, string>>")
    def decoded(contents: pa.Array) -> pa.Array:
        import csv
        import io

        out = []
        for c in contents.to_pylist():
            text = ""
            for e in encodings:
                try:
                    text = c.decode(e)
                    break
                except UnicodeDecodeError:
                    continue
            out.append([list(r.items()) for r in csv.DictReader(io.StringIO(text))])
        return pa.array(out, pa.list_(pa.map_(pa.string(), pa.string())))

    got = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded("content").alias("rows"))
    return got.select("file", F.explode("rows").alias("row"))


def read_rules(spark: SparkSession, folder: str) -> tuple[list[tuple[str, list[str], list[str]]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Non-item categories, aliases and product mappings of a rule folder, in file order.

    Categories may be a list or a map by name, aliases may be raw and standard or source and target, mappings product
    and ingredient or standard_product_name and ingredient_name. A file that isn't there gives no rules.
    """

    def load(name: str) -> dict:
        try:
            rows = spark.read.option("wholetext", True).text(f"{folder}/{name}.json").collect()
        except AnalysisException:
            return {}
        return json.loads(rows[0][0]) if rows else {}

    categories = load("non_item_exclusions").get("categories", [])
    if isinstance(categories, dict):
        categories = [{"name": k, **v} for k, v in categories.items()]
    non_items = [(c["name"], list(c.get("contains", [])), list(c.get("regex", []))) for c in categories]
    pairs = lambda rows, *names: [(r.get(names[0]) or r.get(names[1]), r.get(names[2]) or r.get(names[3])) for r in rows]
    aliases = pairs(load("product_aliases").get("aliases", []), "raw", "source", "standard", "target")
    mapped = load("product_to_ingredient")
    mappings = pairs(next((v for v in mapped.values() if isinstance(v, list)), []), "product", "standard_product_name", "ingredient", "ingredient_name")
    return non_items, [p for p in aliases if all(p)], [p for p in mappings if all(p)]


def label_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """source and name of every label in a folder of JSON lists; files named in skip are left out."""
    rows = spark.read.schema("name string, category string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    got = rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("source"), F.trim("name").alias("name"), "category")
    return got.where(~F.col("source").isin(*skip) if skip else F.lit(True)).where(F.length("name") >= 2)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and length of receipt images, by name: jpg, jpeg and png, without crops of items. Contents aren't read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    return got.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$") & ~F.contains(F.lower("name"), F.lit("items-crop"))).orderBy("name")


def safe_stem(name):
    """A file stem of letters, digits, dots, underscores and hyphens; `receipt` where nothing is left."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^a-zA-Z0-9._-]+", "_"))
    return F.coalesce(F.nullif(F.regexp_replace(stem, "^_+|_+$", ""), F.lit("")), F.lit("receipt"))
