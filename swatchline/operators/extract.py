"""Extraction of literals from lines: every match of a pattern with its byte column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions import color


#: In a round of running sums an element gets so many sums added, less one; rounds that reach 2^32 elements.
RADIX, ROUNDS = 40, 6


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(sizes: str) -> str:
    """SQL of the sums of an array of numbers up to each of its elements, as an array.

    Before round k an element holds the sum of RADIX^k elements, itself the last; it gets those of the RADIX - 1
    stretches before it added. So n elements take log(n) rounds, and rounds that an array is too short for are left out.
    """
    for k in range(ROUNDS):
        x, step = f"x{k}", RADIX**k
        wider = f"transform({x}, (v, i) -> aggregate(sequence(1, {RADIX - 1}), v, (a, j) -> a + coalesce(get({x}, i - j * {step}), 0L)))"
        sizes = f"element_at(transform(array({sizes}), {x} -> CASE WHEN size({x}) > {step} THEN {wider} ELSE {x} END), 1)"
    return sizes


def found(pattern: str, name: str = "value", gate: str | None = None) -> Column:
    """The matches of a pattern in `text`, as an array of (name, col); null if there are none. col is 1-based, in bytes.

    The work grows with a line's length, and but for a logarithm with its matches. Lines without a match are searched
    once, others twice: for the matches, and for what stands between them. gate: a simple pattern that a line with a match fits.
    One SQL text, since a column that is built of so many parts takes longer to build than to run.
    """
    p = sql_string(pattern)
    # split() compiles a long pattern anew for each line, so the matches are replaced by a character that the line lacks
    pieces = f"CASE WHEN contains(text, '\\0') THEN split(text, {p}) ELSE split(regexp_replace(text, {p}, '\\0'), '\\0') END"
    sizes = f"zip_with(m, slice({pieces}, 1, size(m)), (x, gap) -> CAST(octet_length(x) + octet_length(gap) AS BIGINT))"
    ends = f"CASE WHEN size(m) > 1 THEN {running(sizes)} ELSE {sizes} END"  # nearly all lines have one match
    hits = f"zip_with(m, {ends}, (x, e) -> named_struct('{name}', x, 'col', CAST(e - octet_length(x) + 1 AS INT)))"
    got = f"element_at(transform(array(regexp_extract_all(text, {p}, 0)), m -> CASE WHEN size(m) > 0 THEN {hits} END), 1)"
    return F.expr(f"CASE WHEN text RLIKE {sql_string(gate)} THEN {got} END" if gate else got)


def matches(lines: DataFrame, pattern: str, name: str = "value", gate: str | None = None) -> DataFrame:
    """One row per match: the columns of lines, `name`, and col."""
    # the outer form, since Spark evaluates an inner one's array twice: to filter the lines, and to tell its elements
    return lines.select("*", F.inline_outer(found(pattern, name, gate))).where(F.col("col").isNotNull())


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, dims.TRIM, "")


def color_literals(lines: DataFrame) -> DataFrame:
    return matches(lines, dims.COLOR, gate=dims.COLOR_GATE)


def named(match: Column) -> Column:
    """The colour's name in a match of a property with one, in lower case; null if it's none."""
    word = F.lower(F.regexp_extract(match, dims.NAMED_WORD, 1))
    return color.let(word, lambda w: F.when(color.named_color(w).isNotNull(), w))


def named_colors(lines: DataFrame, pattern: str) -> DataFrame:
    """Properties with a named colour: value is the word in lower case, match the whole match."""
    return matches(lines, pattern, "match", r":\s*['\"]?[a-zA-Z]").withColumn("value", named(F.col("match"))).where(F.col("value").isNotNull())


def tailwind_classes(lines: DataFrame) -> DataFrame:
    """Utility classes with their parts; what doesn't parse is dropped."""
    v = F.col("value")
    arbitrary, standard = v.rlike(dims.TW_ARBITRARY), v.rlike(dims.TW_STANDARD)
    special = v.rlike(dims.TW_SPECIAL) & F.regexp_extract(v, dims.TW_SPECIAL, 2).isin(dims.TW_SPECIALS)
    part = lambda p, i: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    rows = matches(lines, dims.TAILWIND).where(arbitrary | standard | special)
    return rows.select(
        "*",
        F.when(arbitrary, part(dims.TW_ARBITRARY, 1)).when(standard, part(dims.TW_STANDARD, 1)).otherwise(part(dims.TW_SPECIAL, 1)).alias("prefix"),
        F.when(arbitrary, None).when(standard, part(dims.TW_STANDARD, 2)).otherwise(part(dims.TW_SPECIAL, 2)).alias("color"),
        F.when(~arbitrary & standard, part(dims.TW_STANDARD, 3)).alias("shade"),
        F.when(arbitrary, None).when(standard, part(dims.TW_STANDARD, 4)).otherwise(part(dims.TW_SPECIAL, 3)).alias("opacity"),
        F.when(arbitrary, part(dims.TW_ARBITRARY, 2)).alias("arbitrary"),
    )


#: Where class lists stand, by what reports call it: patterns, and a simple pattern that a line with one fits.
CLASS_SOURCES = {"className": (dims.CLASS_ATTRIBUTES, "class"), "cn/clsx": (dims.CLASS_FUNCTIONS, r"(?:cn|clsx|twMerge|cva)\(")}


def class_lists(lines: DataFrame, *sources: str) -> DataFrame:
    """The columns of lines, col, classes, source: every class list of the sources, trimmed, comment lines left out.

    All patterns are sought in one pass: the lines may be sorted, and a union of passes would sort them for each.
    """
    none = F.array().cast("array<struct<source:string,match:string,col:int>>")
    told = lambda source, p, gate: F.coalesce(F.transform(found(p, "match", gate), lambda x: F.struct(F.lit(source).alias("source"), x["match"].alias("match"), x["col"].alias("col"))), none)
    hits = F.concat(*(told(s, p, gate) for s in sources for patterns, gate in [CLASS_SOURCES[s]] for p in patterns))
    rows = lines.where(~F.col("text").rlike(dims.COMMENT_LINE_JSX)).select("*", F.inline_outer(hits)).where(F.col("col").isNotNull())
    value = F.filter(F.array(trimmed(F.regexp_extract("match", dims.CLASS_VALUE, 1))), lambda c: c != "")
    arguments = F.transform(F.regexp_extract_all("match", F.lit(dims.CLASS_ARGUMENT), F.lit(1)), trimmed)
    arguments = F.filter(arguments, lambda c: ~c.contains("${") & (c.contains("-") | c.contains(" ")))
    classes = F.explode_outer(F.when(F.col("source") == "className", value).otherwise(arguments))
    return rows.select(*lines.columns, "col", classes.alias("classes"), "source").where("classes is not null")


def class_attributes(lines: DataFrame) -> DataFrame:
    """Class attributes' values, trimmed; blank ones and comment lines are left out."""
    return class_lists(lines, "className").drop("source")


def class_functions(lines: DataFrame) -> DataFrame:
    """Class-like quoted arguments of class functions; the two patterns overlap, and both count."""
    return class_lists(lines, "cn/clsx").drop("source")


def class_tokens(classes: Column) -> Column:
    return F.array_remove(F.split(classes, f"{dims.SPACE}+"), "")


def css_property(text: Column) -> Column:
    """The first property of the line that has a colour, else the first with a quoted value; null if none."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(first(dims.CSS_PROPERTY), first(dims.JS_PROPERTY))


def entry_files(lines: DataFrame, roots: list[str]) -> DataFrame:
    """Lines of the style sheets that may hold a theme: those of fixed names directly in a root, or a root that is one."""
    named = [f"{r.rstrip('/')}/{n}" if r.rstrip("/") not in ("", ".") else n for r in roots for n in dims.TW_ENTRY_FILES]
    return lines.where(F.col("file").isin(named + [r for r in roots if r.lower().endswith(".css")]))


def theme_variables(lines: DataFrame, roots: list[str]) -> DataFrame:
    """Distinct variables of @theme blocks in entry files: file, name. A block may span lines; entry files are small."""
    content = entry_files(lines, roots).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all")).select("file", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("content"))
    rows = content.select("file", F.explode(F.regexp_extract_all("content", F.lit(dims.THEME_BLOCK), F.lit(1))).alias("block")).select("file", F.explode(F.split("block", "\n")).alias("text"))
    return rows.select("file", F.regexp_extract("text", dims.THEME_VAR, 1).alias("name")).where("name <> ''").distinct()
