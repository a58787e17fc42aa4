"""Queries over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions import color
from swatchline.operators import context, extract, match
from swatchline.plans import commands, oracle, report
from swatchline.sources.lines import part_palette, selected, src_lines


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return src_lines(spark.read.parquet(f"{d}/events.parquet"))


def _palette(spark: SparkSession, d: str) -> DataFrame:
    return part_palette(spark.read.parquet(f"{d}/part.parquet"))


PLACE = ("file", "line", "col", "value")


def _values(spark, d):
    """Distinct colour literals and a few that parse oddly."""
    return extract.color_literals(_lines(spark, d)).select("value").distinct()


def _parsed(spark, d):
    rows = _values(spark, d).withColumn("rgb", color.parse_color(F.col("value")))
    return rows.withColumn("lab", color.to_lab(F.col("rgb")))


def _rgb(rows):
    return rows.select("value", *(F.col(f"rgb.{c}").alias(c) for c in "rgb"))


def _compare(spark, d):
    return commands.compare(_lines(spark, d), _palette(spark, d))


def _near(spark, d, semantic: bool):
    rows = _parsed(spark, d)
    if semantic:
        # the properties come behind what the colours alone tell
        rows = match.with_close(rows, _palette(spark, d)).join(F.broadcast(spark.createDataFrame([(x,) for x in oracle.PROPERTIES], "prop string")))
        return match.chosen(rows.withColumn("cat", match.category(F.col("prop")))).select("value", "prop", "near_name", "near_distance")
    return match.nearest(rows, _palette(spark, d)).select("value", "near_name", "near_distance")


def _delta(spark, d):
    # the palette as one row, whose size is checked
    rows = _parsed(spark, d).where("rgb is not null").join(F.broadcast(match.palette_array(_palette(spark, d))))
    rows = rows.select("value", F.col("lab").alias("p"), F.inline("entries"))
    return rows.select("value", "name", color.round2(color.distance(F.col("p"), F.col("lab"))).alias("distance"))


def _half(spark, d):
    """A baseline of the rows of files whose names have an even number of characters."""
    rows = _compare(spark, d)
    return commands.diff(rows, commands.baseline(rows.where(F.length("file") % 2 == 0))).select(*PLACE, "hex", "status")


def _lists(spark, d):
    return commands.class_lists(_lines(spark, d))


def _flat_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    lines = pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("file"), F.posexplode(F.split("html", "\n")).alias("line", "text"))
    return extract.class_attributes(lines.withColumn("line", F.col("line") + 1)).select("file", "line", "col", "classes")


def _typed(rows):
    return rows.withColumn("type", color.color_type(F.col("value")))


def queries() -> dict:
    q = {
        "scan_lines": _lines,
        "palette": _palette,
        "scan_include_glob": lambda s, d: selected(_lines(s, d), "*.{css,html}"),
        "scan_exclude_glob": lambda s, d: selected(_lines(s, d), None, ["**/theme/**", "*.html"]),
        "scan_builtin_excludes": lambda s, d: selected(_lines(s, d)),
        "color_literals": lambda s, d: extract.color_literals(_lines(s, d)).select(*PLACE),
        "named_css": lambda s, d: extract.named_colors(_lines(s, d), dims.NAMED_CSS).select(*PLACE, "match"),
        "named_js": lambda s, d: extract.named_colors(_lines(s, d), dims.NAMED_JS).select(*PLACE, "match"),
        "tailwind_classes": lambda s, d: extract.tailwind_classes(_lines(s, d)).drop("text"),
        "class_attributes": lambda s, d: extract.class_attributes(_lines(s, d)).drop("text"),
        "class_functions": lambda s, d: extract.class_functions(_lines(s, d)).drop("text"),
        "pages_class_attributes": _flat_pages,
        "css_property": lambda s, d: _lines(s, d).select("file", "line", extract.css_property(F.col("text")).alias("prop")),
        "theme_vars": lambda s, d: extract.theme_variables(_lines(s, d), oracle.ROOTS),
        "utility_count": lambda s, d: extract.entry_files(_lines(s, d), oracle.ROOTS).groupBy("file").agg(F.sum(F.regexp_count("text", F.lit(dims.UTILITY))).cast("long").alias("utilities")),
        "tailwind_version": lambda s, d: commands.tailwind_v4(_lines(s, d), oracle.ROOTS),
        "color_type": lambda s, d: _typed(_values(s, d)),
        "parse_hex": lambda s, d: _rgb(_parsed(s, d).where("value like '#%'")),
        "parse_rgb": lambda s, d: _rgb(_parsed(s, d).where("lower(value) like 'rgb%'")),
        "parse_hsl": lambda s, d: _rgb(_parsed(s, d).where("lower(value) like 'hsl%'")),
        "normalize_hex": lambda s, d: _parsed(s, d).select("value", color.to_hex(F.col("rgb")).alias("hex")),
        "rgb_to_lab": lambda s, d: _parsed(s, d).where("rgb is not null").select("value", *(F.round(F.col(f"lab.{c}"), 6).alias(f"lab_{c}") for c in "lab")),
        "delta_e": _delta,
        "alpha": lambda s, d: _values(s, d).select("value", color.alpha(F.col("value")).alias("alpha")),
        "color_mix": lambda s, d: _values(s, d).withColumn("a", color.alpha(F.col("value"))).where("a < 1").select("value", color.color_mix(F.lit("--x"), F.col("a")).alias("mix")),
        "hue_name": lambda s, d: _parsed(s, d).where("rgb is not null").select("value", color.hue_name(F.col("rgb")).alias("hue")),
        "suggest_name": lambda s, d: _parsed(s, d).join(s.createDataFrame([(x,) for x in oracle.PROPERTIES], "prop string")).select("value", "prop", color.suggest_name(F.col("rgb"), F.col("lab"), F.col("prop")).alias("name")),
        "property_category": lambda s, d: _lines(s, d).select(extract.css_property(F.col("text")).alias("prop")).distinct().select("prop", match.category(F.col("prop")).alias("category")),
        "comment_lines": lambda s, d: _lines(s, d).where(F.col("text").rlike(dims.COMMENT_LINE)),
        "block_comments": lambda s, d: context.block_comments(_lines(s, d)).where("in_block").select("file", "line"),
        "interpolation_filter": lambda s, d: _lines(s, d).where("NOT contains(text, '${')").select("file", "line"),
        "type_annotation_filter": lambda s, d: _lines(s, d).where(F.col("text").rlike(dims.TYPE_ANNOTATION) & ~F.col("text").rlike("['\"]")).select("file", "line"),
        "file_info": lambda s, d: context.file_info(_lines(s, d)),
        "context_class": lambda s, d: context.with_context(extract.color_literals(_lines(s, d)), _lines(s, d)).select(*PLACE, "context"),
        "context_counts": lambda s, d: report.counts(commands.colors(_lines(s, d)), "context"),
        "nearest": lambda s, d: _near(s, d, False),
        "nearest_semantic": lambda s, d: _near(s, d, True),
        "colors": lambda s, d: commands.colors(_lines(s, d)),
        "colors_types": lambda s, d: report.counts(commands.colors(_lines(s, d)), "type"),
        "colors_summary": lambda s, d: report.colors_summary(commands.colors(_lines(s, d))),
        "compare": _compare,
        "match_status": lambda s, d: _compare(s, d).groupBy("status", "actionable").agg(F.count("*").alias("n")),
        "suggestion": lambda s, d: _compare(s, d).where("suggestion is not null").select(*PLACE, "suggestion"),
        "name_suggestion": lambda s, d: _compare(s, d).where("name_suggestion is not null").select(*PLACE, "name_suggestion"),
        "compare_summary": lambda s, d: report.compare_summary(_compare(s, d)),
        "compare_examples": lambda s, d: report.examples(_compare(s, d).where("not actionable")).select(*PLACE, "context", "rank", "more"),
        "compare_diff": _half,
        "baseline": lambda s, d: commands.baseline(_compare(s, d)),
        "fixed_lines": lambda s, d: commands.fixed_lines(_lines(s, d), _compare(s, d)),
        "tailwind": lambda s, d: commands.tailwind(_lines(s, d), _palette(s, d)),
        "tailwind_summary": lambda s, d: report.tailwind_summary(commands.tailwind(_lines(s, d), _palette(s, d))),
        "tailwind_prefixes": lambda s, d: report.counts(commands.tailwind(_lines(s, d)), "prefix"),
        "tailwind_colors": lambda s, d: report.counts(commands.tailwind(_lines(s, d)), "color", "arbitrary"),
        "arbitrary_match": lambda s, d: commands.tailwind(_lines(s, d), _palette(s, d)).where("arbitrary is not null").select("value", "near_name", "near_distance", "arbitrary_status").distinct(),
        "patterns": lambda s, d: commands.patterns(_lists(s, d)),
        "class_freq": lambda s, d: commands.class_frequency(_lists(s, d)),
        "class_pairs": lambda s, d: commands.class_pairs(_lists(s, d)),
        "subset_relations": lambda s, d: commands.subset_relations(_lists(s, d)),
        "patterns_locations": lambda s, d: commands.pattern_locations(_lists(s, d)),
        "colors_json": lambda s, d: report.colors_document(commands.colors(_lines(s, d))),
        "compare_json": lambda s, d: report.compare_document(_compare(s, d), _palette(s, d), 10),
        "tailwind_json": lambda s, d: report.tailwind_document(commands.tailwind(_lines(s, d), _palette(s, d)), commands.tailwind_v4_facts(_lines(s, d), oracle.ROOTS)),
        "patterns_json": lambda s, d: report.patterns_document(_lists(s, d)),
        "patterns_summary": lambda s, d: report.patterns_summary(commands.patterns(_lists(s, d))),
    }
    return q


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
