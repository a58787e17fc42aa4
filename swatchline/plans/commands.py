"""The four reports as plans over a table of lines (file, line, text)."""

from __future__ import annotations

import re
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions import color
from swatchline.operators import context, extract, match
from swatchline.sources.exact_files import write_exact


def option_integer(x, default: int) -> int:
    """A whole option: the digits that its text begins with, what follows them aside; none, and 0, give the default."""
    found = re.match(r"\s*[-+]?\d+", str(x))
    return (int(found[0]) if found else 0) or default


def option_number(x, default: float) -> float:
    """A numeric option: the number that its text begins with; what begins with none, and 0, give the default."""
    found = re.match(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", str(x))
    return (float(found[0]) if found else 0.0) or default


LITERALS = {"literal": (dims.COLOR, dims.COLOR_GATE)}
NAMED = {"css": (dims.NAMED_CSS, dims.NAMED_CSS_GATE), "js": (dims.NAMED_JS, dims.NAMED_JS_GATE)}


def _hits(lines: DataFrame, patterns: dict) -> DataFrame:
    """Colours outside comment lines, literals outside block comments and templates, typed, with the facts of their files."""
    rows = context.scanned(lines, patterns).where(~F.col("text").rlike(dims.COMMENT_LINE))
    literal = F.col("kind") == "literal"
    rows = rows.withColumn("value", F.when(literal, F.col("match")).otherwise(extract.named(F.col("match")))).where(F.col("value").isNotNull())
    rows = rows.withColumn("type", F.when(literal, color.color_type(F.col("value"))).otherwise("named"))
    return rows.where(~literal | ((F.col("type") != "unknown") & ~F.col("in_block") & ~F.col("value").contains("${")))


def _first_of_place(rows: DataFrame) -> DataFrame:
    """Of several at one place a literal goes first, then a CSS property's, then a JS one's."""
    rank = F.when(F.col("kind") == "literal", 0).when(F.col("kind") == "css", 1).otherwise(2)
    # a line has one chunk; named too, since the rows lie by file and chunk already and needn't move then
    by = Window.partitionBy("file", "chunk", "line", "col").orderBy(rank, "value")
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def colors(lines: DataFrame, named: bool = True) -> DataFrame:
    """file, line, col, value, type, hex, text, context, label, actionable of every colour literal."""
    typed = F.col("text").rlike(dims.TYPE_ANNOTATION) & ~F.col("text").rlike("['\"]")
    rows = _hits(lines, LITERALS | (NAMED if named else {})).where((F.col("kind") != "literal") | ~typed)
    rows = _first_of_place(rows).withColumn("hex", color.to_hex(color.parse_color(F.col("value"))))
    rows = rows.withColumn("context", context.context(F.col("text"), F.col("match")))
    return rows.select("file", "line", "col", "value", "type", "hex", "text", "context", context.context_label(F.col("context")).alias("label"), (F.col("context") == "actionable").alias("actionable"))


def compare(lines: DataFrame, palette: DataFrame, threshold: float = 10) -> DataFrame:
    """Colour literals with their palette entry by meaning, status and suggestions."""
    rows = _first_of_place(_hits(lines, LITERALS)).withColumn("prop", extract.css_property(F.col("text"))).withColumn("rgb", color.parse_color(F.col("value")))
    rows = rows.withColumn("lab", color.to_lab(F.col("rgb"))).withColumn("cat", match.category(F.col("prop"))).withColumn("hex", color.to_hex(F.col("rgb")))
    rows = match.nearest_semantic(rows, palette).withColumn("status", match.status(option_number(threshold, 10)))
    rows = rows.withColumn("context", context.context(F.col("text"), F.col("value"))).withColumn("actionable", F.col("context") == "actionable")
    rows = rows.withColumn("suggestion", F.when(F.col("actionable"), match.suggestion(color.alpha(F.col("value")))))
    rows = rows.withColumn("name_suggestion", F.when((F.col("status") == "unmatched") & F.col("actionable"), color.suggest_name(F.col("rgb"), F.col("lab"), F.col("prop"))))
    return rows.select("file", "line", "col", "value", "type", "hex", "text", "context", "actionable", "prop", "status", "near_name", "near_hex", "near_distance", "suggestion", "name_suggestion")


def _against(rows: DataFrame, baseline: DataFrame, how: str) -> DataFrame:
    """rows joined to the baseline by file, value and hex; a null hex equals a null hex."""
    old = baseline.select(F.col("file").alias("_f"), F.col("value").alias("_v"), F.col("hex").alias("_h")).distinct()
    return rows.join(old, (F.col("file") == F.col("_f")) & (F.col("value") == F.col("_v")) & F.col("hex").eqNullSafe(F.col("_h")), how)


def diff(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows whose file, value and hex aren't in the baseline."""
    return _against(rows, baseline, "left_anti")


def diff_counts(rows: DataFrame, baseline: DataFrame) -> tuple[int, int]:
    """How many rows are new, and how many the baseline has already."""
    got = _against(rows, baseline, "left").agg(F.count("*").alias("all"), F.count("_f").alias("known")).first()
    return got["all"] - got["known"], got["known"]


def baseline(rows: DataFrame) -> DataFrame:
    return rows.select("file", "line", "col", "value", "hex", "status", "context")


def save_baseline(rows: DataFrame, path: str) -> None:
    """Writes the baseline as JSON lines below a path that Spark can write; an earlier one there is replaced."""
    baseline(rows).write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame | None:
    """A saved baseline. Where there is none, or not all of it can be parsed: a warning, and None."""
    fields = "file string, line int, col int, value string, hex string, status string, context string, _bad string"
    try:
        old = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        warnings.warn(f"no baseline at {path}: all rows are new", stacklevel=2)
        return None
    if old.where("_bad is not null or file is null").head(1):
        warnings.warn(f"the baseline at {path} can't be parsed: all rows count as new", stacklevel=2)
        return None
    return old


def since_baseline(rows: DataFrame, path: str) -> DataFrame:
    """Rows that a saved baseline lacks; all rows where it can't be read."""
    old = read_baseline(rows.sparkSession, path)
    return rows if old is None else diff(rows, old)


def _raw(lines: DataFrame) -> DataFrame:
    """lines with raw and ending; a table of texts alone has its texts, each with a line feed."""
    return lines if "raw" in lines.columns else lines.withColumns({"raw": F.col("text"), "ending": F.lit("\n")})


def fixed_tree(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Every line of every changed file: file, line, data (its bytes with its end), n_fixed. Only replaced values differ."""
    raw = _raw(lines).select("file", "line", "raw", "ending")
    changed = fixed_lines(raw.withColumnRenamed("raw", "text"), rows).select("file", "line", F.col("text").alias("_new"), "n_fixed")
    files = changed.select("file").distinct()
    out = raw.join(files, "file", "left_semi").join(changed, ["file", "line"], "left")
    return out.select("file", "line", F.concat(F.coalesce("_new", "raw"), "ending").cast("binary").alias("data"), F.coalesce("n_fixed", F.lit(0)).alias("n_fixed"))


def fixed_files(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Every changed file as a whole: file, content, n_fixed. For files that fit into a row; write_fixed() streams any.

    Texts without their line ends are joined by line feeds, with none behind the last.
    """
    text = F.col("data").cast("string")
    whole = fixed_tree(lines, rows).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))).alias("all"), F.sum("n_fixed").alias("n_fixed"))
    content = F.array_join(F.col("all.text"), "")
    if "raw" not in lines.columns:
        content = F.left(content, F.length(content) - 1)
    return whole.select("file", content.alias("content"), "n_fixed")


def write_fixed(lines: DataFrame, rows: DataFrame, folder: str) -> int:
    """Writes the changed files below a new folder, each at its own name and byte for byte; the count of fixes.

    The count is told while they are written, by one run of the plan.
    """
    told = Observation()
    write_exact(fixed_tree(lines, rows).observe(told, F.coalesce(F.sum("n_fixed"), F.lit(0)).alias("n")), folder)
    return int(told.get["n"])


def fixed_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Changed lines: file, line, text, n_fixed. Exact, actionable rows are replaced from the right.

    A value is sought from one character before its column; one that isn't found there is skipped.
    """
    edits = rows.where("actionable and status = 'exact' and suggestion is not null").groupBy("file", "line").agg(F.sort_array(F.collect_list(F.struct("col", "value", "suggestion")), asc=False).alias("edits"))
    start = "named_struct('text', text, 'n', 0)"
    at = "locate(e.value, acc.text, greatest(e.col - 1, 1))"
    step = f"(acc, e) -> CASE WHEN {at} > 0 THEN named_struct('text', concat(left(acc.text, {at} - 1), e.suggestion, substring(acc.text, {at} + length(e.value))), 'n', acc.n + 1) ELSE acc END"
    return lines.join(edits, ["file", "line"]).select("file", "line", F.expr(f"aggregate(edits, {start}, {step})").alias("x")).select("file", "line", "x.text", F.col("x.n").alias("n_fixed")).where("n_fixed > 0")


def tailwind(lines: DataFrame, palette: DataFrame | None = None, threshold: float = 10) -> DataFrame:
    """Colour utility classes; arbitrary values get their nearest palette entry."""
    rows = extract.tailwind_classes(lines.where(~F.col("text").rlike(dims.COMMENT_LINE))).dropDuplicates(["file", "line", "col", "value"])
    rows = rows.withColumn("lab", color.to_lab(color.parse_color(F.col("arbitrary"))))
    if palette is None:
        rows = rows.withColumns({"near_name": F.lit(None).cast("string"), "near_hex": F.lit(None).cast("string"), "near_distance": F.lit(None).cast("double")})
    else:
        rows = match.nearest(rows, palette)
    d = F.col("near_distance")
    rows = rows.withColumn("arbitrary_status", F.when(d == 0, "exact").when(d <= option_number(threshold, 10), "close"))
    shown = F.regexp_replace(d.cast("string"), r"\.0$", "")
    # fixed values: the wording of the suggestions
    exact = F.concat(F.lit("Use var("), "near_name", F.lit(") or a Tailwind theme color instead of "), "arbitrary")
    close = F.concat(F.lit("Close to "), "near_name", F.lit(" ("), "near_hex", F.lit(", dE="), shown, F.lit(")"))
    rows = rows.withColumn("suggestion", F.when(F.col("arbitrary_status") == "exact", exact).when(F.col("arbitrary_status") == "close", close))
    return rows.select("file", "line", "col", "value", "prefix", "color", "shade", "opacity", "arbitrary", extract.trimmed(F.col("text")).alias("context"), "near_name", "near_hex", "near_distance", "arbitrary_status", "suggestion")


def tailwind_v4_facts(lines: DataFrame, roots: list[str]) -> DataFrame:
    """One row: version, theme_vars, utilities, and files with a theme as an array."""
    entry = extract.entry_files(lines, roots)
    opens = F.col("text").rlike(dims.THEME_OPEN)
    counts = entry.agg(F.coalesce(F.bool_or(opens), F.lit(False)).alias("v4"), F.coalesce(F.sum(F.regexp_count("text", F.lit(dims.UTILITY))), F.lit(0)).cast("long").alias("utilities"), F.array_sort(F.collect_set(F.when(opens, F.col("file")))).alias("files"))
    names = extract.theme_variables(lines, roots).agg(F.count("*").alias("theme_vars"))
    return counts.join(names).select(F.when(F.col("v4"), 4).otherwise(3).alias("version"), "theme_vars", "utilities", "files")


def tailwind_v4(lines: DataFrame, roots: list[str]) -> DataFrame:
    """One row: version, theme_vars, utilities, files with a theme, joined by commas."""
    return tailwind_v4_facts(lines, roots).withColumn("files", F.array_join("files", ","))


def class_lists(lines: DataFrame, min_classes: int = 2) -> DataFrame:
    """Every class list: file, line, col, classes, source, tokens. Nothing is deduplicated."""
    rows = extract.class_lists(lines, *extract.CLASS_SOURCES)
    return rows.withColumn("tokens", extract.class_tokens(F.col("classes"))).where(F.size("tokens") >= min_classes)


def all_patterns(lists: DataFrame) -> DataFrame:
    # nothing but pattern and n, from which the rest is told: so a plan that needs it more than once groups the lists once.
    # For that no use may add a filter of its own below: hence the one for nulls here, and outer forms of explode.
    return lists.where(F.array_join(F.array_sort("tokens"), " ").isNotNull()).groupBy(F.array_join(F.array_sort("tokens"), " ").alias("pattern")).agg(F.count("*").alias("n")).withColumn("class_count", F.size(_classes("pattern")))


def _classes(pattern: Column | str) -> Column:
    """The classes of a pattern, repeated ones too."""
    return F.array_remove(F.split(pattern, " "), "")


def patterns(lists: DataFrame, min_count: int = 2) -> DataFrame:
    return all_patterns(lists).where(F.col("n") >= min_count).withColumn("impact", F.col("n") * F.col("class_count"))


def pattern_locations(lists: DataFrame, min_count: int = 2) -> DataFrame:
    """Every place of the patterns that are reported: pattern, file, line, col, original, context, source."""
    rows = lists.withColumn("pattern", F.array_join(F.array_sort("tokens"), " "))
    found = rows.join(patterns(lists, min_count).select("pattern"), "pattern")
    return found.select("pattern", "file", "line", "col", F.col("classes").alias("original"), extract.trimmed(F.col("text")).alias("context"), "source")


def class_frequency(lists: DataFrame) -> DataFrame:
    return all_patterns(lists).select(F.explode_outer(_classes("pattern")).alias("class"), "n").where("class is not null").groupBy("class").agg(F.sum("n").alias("n"))


def class_pairs(lists: DataFrame, min_count: int = 2, top: int = 20) -> DataFrame:
    """The pairs of classes that stand together most; ties by name. The report holds the first `top`."""
    # formed within a pattern; frequent pairs are few, and those of a class that is not frequent by itself go
    own = F.split("pattern", " ")
    pairs = F.flatten(F.transform(F.array(own), lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.concat_ws(" ", x, y))))))
    pairs = all_patterns(lists).select("n", F.explode_outer(pairs).alias("pair")).where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    frequent, pairs = class_frequency(lists).where(F.col("n") >= min_count).select("class"), pairs.where(F.col("n") >= 2 * min_count)
    for i in (0, 1):
        pairs = pairs.join(frequent, F.split("pair", " ")[i] == F.col("class"), "left_semi")
    return pairs.orderBy(F.desc("n"), "pair").limit(top)


def subset_relations(lists: DataFrame, min_count: int = 2, top: int = 10) -> DataFrame:
    """Patterns whose set of classes is a proper subset of another's; joined on the rarest class of the smaller set."""
    rows = patterns(lists, min_count).withColumn("classes", F.array_distinct(F.split("pattern", " ")))
    each = rows.select("pattern", F.explode_outer("classes").alias("class")).where("class is not null")
    rare = each.join(each.groupBy("class").agg(F.count("*").alias("c")), "class").groupBy("pattern").agg(F.min_by("class", F.struct("c", "class")).alias("class"))
    small = rows.join(rare, "pattern").select(F.col("pattern").alias("subset"), F.col("impact").alias("i"), F.col("n").alias("subset_count"), F.col("classes").alias("a"), "class")
    large = rows.select(F.col("pattern").alias("superset"), F.col("impact").alias("j"), F.col("n").alias("superset_count"), F.col("classes").alias("b"), F.explode_outer("classes").alias("class"))
    found = small.join(large, "class").where("size(a) < size(b) and size(array_except(a, b)) = 0")
    found = found.orderBy(F.desc("i"), "subset", F.desc("j"), "superset").limit(top)
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return found.select("subset", "superset", "subset_count", "superset_count", joined("a").alias("shared"), joined(F.array_except("b", "a")).alias("extra"))
