"""Palettes (ord, name, hex) from CSS, JSON and JS text. ord is the order in which names first appear."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions import color


def _ordered(found: DataFrame) -> DataFrame:
    """(place, name, value) to (ord, name, hex): values that aren't colours go; a repeated name keeps its first place and
    its last value; names that are integers come first, in order."""
    rows = found.withColumn("hex", color.to_hex(color.parse_color(F.col("value")))).where("hex is not null")
    rows = rows.groupBy("name").agg(F.min("place").alias("place"), F.max_by("hex", "place").alias("hex"))
    number = F.when(F.col("name").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("name").cast("long"))
    return rows.select(F.row_number().over(Window.orderBy(F.asc_nulls_last(number), "place")).alias("ord"), "name", "hex")


def _pairs(spark: SparkSession, text: str, pattern: str, prefix: str) -> DataFrame:
    one = spark.createDataFrame([(text,)], "text string")
    rows = one.select(F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "hit"))
    return rows.select("place", F.concat(F.lit(prefix), F.regexp_extract("hit", pattern, 1)).alias("name"), F.regexp_extract("hit", pattern, 2).alias("value"))


def from_css(spark: SparkSession, text: str) -> DataFrame:
    return _ordered(_pairs(spark, text, dims.PALETTE_CSS, "--"))


def from_js(spark: SparkSession, text: str) -> DataFrame:
    return _ordered(_pairs(spark, text, dims.PALETTE_JS, ""))


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """Leaves of nested objects under dotted names; what isn't JSON gives no rows."""
    try:
        tree = json.loads(text)
    except ValueError:
        tree = {}
    rows: list[tuple[int, str, str]] = []
    todo = [("", tree)]
    while todo:
        prefix, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{prefix}.{k}" if prefix else k, v) for k, v in reversed(node.items())]
        elif isinstance(node, str) and prefix:
            rows.append((len(rows), prefix, node))
    return _ordered(spark.createDataFrame(rows, "place int, name string, value string"))


def read_palette(spark: SparkSession, path: str) -> DataFrame | None:
    """By the file's extension, else the first of CSS, JSON and JS that gives colours; None if there is no such file."""
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        text = f.read()
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    if ext == "json":
        return from_json(spark, text)
    if ext in dims.STYLE_EXTENSIONS:
        return from_css(spark, text)
    if ext in ("js", "ts", "mjs", "cjs"):
        return from_js(spark, text)
    for way in (from_css, from_json):
        if (found := way(spark, text)).head(1):
            return found
    return from_js(spark, text)
