"""Summaries and documents of the plans.

A document is a table (section, part, value): a summary, counts, and the rows of the report in their sections, each value
as JSON. So a document of any size is written in parallel, and read back by its sections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchline.plans import commands

#: Schemas as printed for users, by command.
SCHEMAS = {
    "colors": "file string, line int, col int, value string, type string, hex string?, text string, context string, label string, actionable boolean",
    "tailwind": "file string, line int, col int, value string, prefix string, color string?, shade string?, opacity string?, arbitrary string?, context string, near_name string?, near_hex string?, near_distance double?, arbitrary_status string?, suggestion string?",
    "compare": "file string, line int, col int, value string, type string, hex string?, text string, context string, actionable boolean, prop string?, status string, near_name string?, near_hex string?, near_distance double?, suggestion string?, name_suggestion string?",
    "patterns": "pattern string, n long, class_count int, impact long",
}
STATUSES = ("exact", "close", "unmatched")
#: Columns by which each report is ordered, ascending; patterns by falling impact.
ORDER = {"colors": ("file", "line", "col"), "tailwind": ("file", "line", "col"), "compare": ("file", "line", "col")}


def by_name(column: str = "file") -> list[Column]:
    """The order of names for people: by the root collation of Unicode, in which case and accents part only equal names."""
    return [F.collate(column, "UNICODE"), F.col(column)]


def ordered(command: str, rows: DataFrame) -> DataFrame:
    """Rows in the order in which a report tells them; ties by what is left."""
    return rows.orderBy(F.desc("impact"), "pattern") if command == "patterns" else rows.orderBy(*by_name(), *ORDER[command][1:], "value")


def counts(rows: DataFrame, key: str, fallback: str = "unknown") -> DataFrame:
    """Rows by key; null and empty keys count under the fallback."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(fallback)).alias("key")).agg(F.count("*").alias("n"))


def colors_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_distinct("file").alias("files"), F.count_if("actionable").alias("actionable"), F.count_if(~F.col("actionable")).alias("skipped"))


def compare_summary(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("actionable") & (F.col("status") == s)).alias(s)
    return rows.agg(F.count("*").alias("total"), *map(n, STATUSES), F.count_if(~F.col("actionable")).alias("skipped"), F.count_distinct("file").alias("files"))


def tailwind_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_distinct("file").alias("files"), F.count("arbitrary").alias("arbitrary"), F.count_if(F.col("arbitrary").isNotNull() & F.col("near_name").isNotNull()).alias("arbitrary_with_match"))


def patterns_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("locations"))


def examples(rows: DataFrame, key: str = "context", most: int = 3) -> DataFrame:
    """The first `most` rows of each key, and how many more there are."""
    by = Window.partitionBy(key)
    first = by.orderBy("file", "line", "col")
    return rows.withColumn("rank", F.row_number().over(first)).withColumn("more", F.count("*").over(by) - most).where(F.col("rank") <= most)


def by_file(rows: DataFrame) -> DataFrame:
    """One row per file with its hits in order."""
    return rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "col", "value"))).alias("hits"))


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(_json("*").alias("value"))


def _part(section: str, part: Column, value: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), part.cast("string").alias("part"), value.cast("string").alias("value"))


def _summary(rows: DataFrame, command: str, *columns: Column) -> DataFrame:
    return _part("summary", F.lit(None), _json(F.lit(command).alias("command"), *columns), rows)


def _tally(section: str, rows: DataFrame, key: str, fallback: str = "unknown") -> DataFrame:
    return _part(section, F.col("key"), F.col("n"), counts(rows, key, fallback))


def _rows(section: str, part: str, rows: DataFrame, *columns: Column | str) -> DataFrame:
    return _part(section, F.col(part), _json(*(columns or ["*"])), rows)


def _document(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def colors_document(rows: DataFrame) -> DataFrame:
    facts = rows.agg(F.count("*").alias("totalColors"), F.count_if("actionable").alias("actionable"), F.count_if(~F.col("actionable")).alias("skipped"), F.count_distinct("file").alias("totalFiles"))
    yes, no = rows.where("actionable"), rows.where("not actionable")
    return _document(_summary(facts, "colors", F.col("*")), _tally("byType", rows, "type"), _tally("skippedByContext", no, "context"), _rows("actionable", "file", yes), _rows("skipped", "file", no))


def compare_document(rows: DataFrame, palette: DataFrame, threshold: float) -> DataFrame:
    # the report is worked out twice, not for each of its parts: for a few counts, and for its rows
    groups = rows.groupBy("actionable", "status", "context").agg(F.count("*").alias("n"))
    many = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    yes = F.col("actionable")
    n = lambda which: F.struct(*(many((F.col("status") == s) & which).alias(s) for s in STATUSES))
    facts = groups.agg(F.lit(float(threshold)).alias("threshold"), many(F.lit(True)).alias("total"), many(yes).alias("actionable"), many(~yes).alias("skipped"), n(F.lit(True)).alias("byStatus"), n(yes).alias("actionableByStatus"))
    key = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("unknown"))
    skipped = _part("skippedByContext", F.col("key"), F.col("n"), groups.where(~yes).groupBy(key.alias("key")).agg(F.sum("n").alias("n")))
    told = rows.where(yes.isNotNull()).select(F.when(yes, "actionable").otherwise("skipped").alias("section"), F.when(yes, F.col("status")).otherwise(F.col("context")).alias("part"), _json("*").alias("value"))
    return _document(_summary(facts, "compare", F.col("*")), _rows("palette", "name", palette, "name", "hex"), skipped, told)


def tailwind_document(rows: DataFrame, v4: DataFrame) -> DataFrame:
    """v4: the row of commands.tailwind_v4_facts, whose version the summary names; version 4 has a section of its own."""
    facts = rows.agg(F.count("*").alias("totalClasses"), F.count_distinct("file").alias("totalFiles"), F.count("arbitrary").alias("arbitraryValues"), F.count_if(F.col("arbitrary").isNotNull() & F.col("near_name").isNotNull()).alias("arbitraryWithThemeMatch"))
    facts = v4.select(F.col("version").alias("tailwindVersion")).join(facts)  # one row and one row
    found = _part("v4", F.lit(None), _json(F.col("theme_vars").alias("themeVars"), "utilities", "files"), v4.where("version = 4"))
    return _document(_summary(facts, "tailwind", F.col("*")), _tally("byPrefix", rows, "prefix"), _tally("byColor", rows, "color", "arbitrary"), _rows("results", "file", rows), found)


def patterns_document(lists: DataFrame, min_count: int = 2, min_classes: int = 2) -> DataFrame:
    found, subsets = commands.patterns(lists, min_count), commands.subset_relations(lists, min_count)
    facts = found.agg(F.count("*").alias("totalPatterns"), F.lit(min_count).alias("minCount"), F.lit(min_classes).alias("minClasses"), F.coalesce(F.sum("n"), F.lit(0)).alias("totalLocations"))
    facts = facts.join(subsets.agg(F.count("*").alias("subsetRelations")))  # one row and one row
    told = [F.col("pattern").alias("normalized"), F.col("class_count").alias("classCount"), F.col("n").alias("occurrences"), F.col("impact").alias("impactScore")]
    return _document(
        _summary(facts, "patterns", F.col("*")), _rows("patterns", "pattern", found, *told), _rows("locations", "pattern", commands.pattern_locations(lists, min_count)),
        _rows("subsetRelations", "subset", subsets), _rows("frequentSubsets", "pair", commands.class_pairs(lists, min_count)),
    )
