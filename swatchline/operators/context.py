"""Comments, file properties and the context of a hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions.color import let
from swatchline.operators import extract
from swatchline.operators.extract import trimmed


def _any(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns))


#: Lines of a chunk: what a line says is gathered by chunks, and chunks of one file are worked on apart.
CHUNK = 4096


def chunk(line: Column) -> Column:
    return F.floor((line - 1) / CHUNK).cast("long")


def comment_mark(text: Column) -> Column:
    """What a line does to the state of a block comment: 1 opens, 0 closes, 2 does both and flips it; null does nothing."""
    at = F.instr(text, "/*")
    opens = (at > 0) & ~F.substring(text, at + 2, F.length(text)).contains("*/")
    closes = text.contains("*/")
    return F.when(opens & closes, 2).when(opens, 1).when(closes, 0)


def _after(state: Column, mark: Column) -> Column:
    return F.when(mark.isNull(), state).when(mark == 2, 1 - state).otherwise(mark)


def comment_starts(chunks: DataFrame) -> DataFrame:
    """chunks (file, chunk, marks in order of lines, and more) with `start`, the state before the chunk's first line.

    A chunk is a function of the state before it, known by its values for 0 and 1: it forces a state, flips the one
    before or keeps it. Chunks are composed in their order, one row each; a file's state then is the last forced one,
    flipped as often as chunks since then flip it.
    """
    ends = [F.aggregate("marks", F.lit(s), lambda acc, m: _after(acc, m).cast("int")) for s in (0, 1)]
    rows = chunks.withColumn("_ends", F.struct(ends[0].alias("a"), ends[1].alias("b"))).drop("marks")
    a, b = F.col("_ends.a"), F.col("_ends.b")
    by = Window.partitionBy("file").orderBy("chunk")
    rows = rows.withColumn("_flips", F.sum(F.when((a == 1) & (b == 0), 1).otherwise(0)).over(by))
    rows = rows.withColumn("_last", F.last(F.when(a == b, F.struct(a.alias("state"), F.col("_flips").alias("flips"))), ignorenulls=True).over(by))
    after = F.when(F.col("_last").isNull(), F.col("_flips") % 2).otherwise((F.col("_last.state") + F.col("_flips") - F.col("_last.flips")) % 2)
    return rows.withColumn("start", F.coalesce(F.lag(after).over(by), F.lit(0)).cast("int")).drop("_ends", "_flips", "_last")


def in_blocks(start: Column, marks: Column) -> Column:
    """For each of a chunk's marks in order, whether its line is in a block comment: before it or after it."""
    step = lambda acc, m: let(_after(acc["s"], m).cast("int"), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array((acc["s"] == 1) | (s == 1))).alias("out")))
    return F.aggregate(marks, F.struct(start.alias("s"), F.array().cast("array<boolean>").alias("out")), step)["out"]


def block_comments(lines: DataFrame) -> DataFrame:
    """lines with in_block: the line is inside a block comment before or after its own markers.

    Only lines with markers are gathered, by chunks; a file's chunks are worked on apart.
    """
    mark = comment_mark(F.col("text"))
    chunks = lines.groupBy("file", chunk(F.col("line")).alias("chunk")).agg(F.array_sort(F.collect_list(F.when(mark.isNotNull(), F.struct("line", mark.alias("mark"))))).alias("at"))
    starts = comment_starts(chunks.withColumn("marks", F.col("at.mark")))
    inside = F.arrays_zip(F.col("at.line").alias("line"), in_blocks(F.col("start"), F.col("at.mark")).alias("inside"), F.col("at.mark").alias("mark"))
    # the state between two marks is that behind the first: told by the lines at which it changes
    states = starts.select(F.col("file").alias("_f"), F.col("chunk").alias("_c"), "start", inside.alias("at")).where("start = 1 or size(at) > 0")
    rows = lines.join(states, (F.col("file") == F.col("_f")) & (chunk(F.col("line")) == F.col("_c")), "left")
    before = F.aggregate(F.filter("at", lambda x: x["line"] < F.col("line")), F.col("start"), lambda acc, x: _after(acc, x["mark"]).cast("int"))
    own = _after(F.col("_before"), comment_mark(F.col("text")))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("in_block", (F.col("_before") == 1) | (own == 1)).select(*lines.columns, "in_block")


def _facts(line: Column, t: Column) -> dict[str, Column]:
    """What a line says about its file."""
    libraries = "(?i)(?:from|require)\\s*\\(?\\s*['\"](?:" + "|".join(x.replace(".", "\\.") for x in dims.CANVAS_IMPORTS) + ")"
    return {
        "_canvas": (line <= dims.IMPORT_LINES) & (t.rlike(libraries) | t.rlike(dims.OG_IMAGE)),
        "_builder": t.contains("Theme") & _any(t, dims.THEME_BUILDERS),
        "_usage": t.contains("getCssVar") | t.contains("getComputedStyle"),
    }


def _file_columns() -> list[Column]:
    """The properties of a file by its name and by what its lines say."""
    name = F.col("file")
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    script = ext.isin(dims.SCRIPT_EXTENSIONS)
    return [
        (script & F.col("_canvas")).alias("is_canvas"), _any(name, dims.DEFINITION_FILES).alias("is_definition"), _any(name, dims.MAPPING_FILES).alias("is_mapping"),
        (script & F.col("_builder")).alias("is_builder"), (script & F.col("_usage")).alias("has_usage"), ext.isin(dims.STYLE_EXTENSIONS).alias("is_style"),
    ]


def file_info(lines: DataFrame) -> DataFrame:
    """One row per file: what its name and content say."""
    info = lines.groupBy("file").agg(*(F.bool_or(c).alias(k) for k, c in _facts(F.col("line"), F.col("text")).items()))
    return info.select("file", *_file_columns())


FILE_COLUMNS = ["is_canvas", "is_definition", "is_mapping", "is_builder", "has_usage", "is_style"]


def scanned(lines: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per match of any of the patterns: file, chunk, line, text, kind, match, col, in_block and the columns of file_info.

    patterns: kind to (pattern, gate). One pass over the lines tells matches,
    comment markers and facts of the file; lines that have none of these don't move. The rest meet by chunks of files,
    and the states and facts of a file are told from one row for each of its chunks.
    """
    line, text = F.col("line"), F.col("text")
    none = F.array().cast("array<struct<kind:string,match:string,col:int>>")
    hits = F.concat(*(F.coalesce(F.transform(extract.found(p, "match", gate), lambda x: F.struct(F.lit(kind).alias("kind"), x["match"].alias("match"), x["col"].alias("col"))), none) for kind, (p, gate) in patterns.items()))
    facts = _facts(line, text)
    said = F.struct(hits.alias("hits"), comment_mark(text).alias("mark"), *(c.alias(k) for k, c in facts.items()))
    anything = lambda e: (F.size(e["hits"]) > 0) | e["mark"].isNotNull() | reduce(lambda a, b: a | b, (e[k] for k in facts))
    told = lambda e: F.struct(line.alias("line"), F.when(F.size(e["hits"]) > 0, text).alias("text"), e["hits"].alias("hits"), e["mark"].alias("mark"), *(e[k].alias(k) for k in facts))
    each = lines.select("file", chunk(line).alias("chunk"), F.explode_outer(let(said, lambda e: F.when(anything(e), F.array(told(e))))).alias("e"))
    # without the nulls that the join below leaves out anyway, so that both its sides are the same up to their exchange
    each = each.where(F.col("e").isNotNull() & F.col("file").isNotNull() & F.col("chunk").isNotNull())
    # both the summary and the rows themselves come of this exchange, which Spark makes once
    groups = each.repartition("file", "chunk").groupBy("file", "chunk").agg(F.collect_list("e").alias("rows"))
    by_line = F.array_sort("rows", lambda a, b: F.when(a["line"] < b["line"], -1).when(a["line"] > b["line"], 1).otherwise(0))
    groups = groups.withColumn("rows", by_line)
    summary = comment_starts(groups.select("file", "chunk", F.col("rows.mark").alias("marks"), *(F.exists("rows", lambda r: r[k]).alias(k) for k in facts)))
    of_file = Window.partitionBy("file")
    summary = summary.select("file", "chunk", "start", *(F.max(k).over(of_file).alias(k) for k in facts))
    rows = groups.join(summary, ["file", "chunk"]).withColumn("inside", in_blocks(F.col("start"), F.col("rows.mark")))
    rows = rows.select("file", "chunk", *_file_columns(), F.inline(F.zip_with("rows", "inside", lambda r, i: F.struct(r["line"].alias("line"), r["text"].alias("text"), r["hits"].alias("hits"), i.alias("in_block")))))
    return rows.select("file", "chunk", "line", "text", "in_block", *FILE_COLUMNS, F.inline("hits"))


def context(text: Column, value: Column) -> Column:
    """The first rule that holds; the columns of file_info must be at hand."""
    c = F.coalesce
    no = F.lit(False)
    canvas, builder, usage, style, definition, mapping = (c(F.col(x), no) for x in ("is_canvas", "is_builder", "has_usage", "is_style", "is_definition", "is_mapping"))

    def rules(t: Column) -> Column:
        return (
            F.when(t.rlike(dims.DEFINES), "css-definition")
            .when(canvas | (usage & ~style), "canvas")
            .when(builder, "theme-definition")
            .when(definition, F.when(t.contains("var(--"), "actionable").otherwise("theme-definition"))
            .when(mapping, "mapping")
            .when(t.rlike(dims.META_VALUE) & t.rlike(dims.META_TAG), "meta")
            .when(t.rlike(dims.TEMPLATE_OPEN) & t.rlike(dims.TEMPLATE_VALUE), "generated")
            .when(t.rlike(dims.KEY_CSS) & F.element_at(F.split(t, ":"), -1).rlike(dims.KEY_SUFFIX), "mapping")
            .when(t.rlike(dims.KEY_HEX) | t.rlike(dims.KEY_STRING), "mapping")
            .when(t.rlike(dims.BRIDGE) | t.rlike(dims.FALLBACK), "canvas")
            .when(_any(F.lower(value), dims.EFFECTS), "effect")
            .when(value.rlike(dims.EFFECT_HEX) & t.rlike(dims.EFFECT_LINE), "effect")
            .otherwise("actionable")
        )

    return let(trimmed(text), rules)


def with_context(hits: DataFrame, lines: DataFrame, value: str = "value") -> DataFrame:
    return hits.join(file_info(lines), "file", "left").withColumn("context", context(F.col("text"), F.col(value))).drop(*FILE_COLUMNS)


def context_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in dims.CONTEXT_LABELS.items() for x in kv)), c), c)
