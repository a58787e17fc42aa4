"""Reports for people, as tables of lines in order: any number of rows, told from the first to the last.

A report is one table (part, file, line, col, step, text), built of sections and sorted by Spark: names by the root
collation, then places. Only the line that is being printed is at the driver with those of its partition; write() keeps
the order in the names of its parts. The wording of lines is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchline.operators import context
from swatchline.plans import commands, report

FIRST, LAST = -1, 2**31 - 1


def _f(form: str, **columns: Column | str) -> Column:
    """A line of fixed text with columns in it; a null column is empty."""
    parts, rest = [], form
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        got = columns.get(name, name)
        parts += [F.lit(before), F.coalesce((F.col(got) if isinstance(got, str) else got).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _number(c: str) -> Column:
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def _section(part: int, rows: DataFrame, *lines: Column, file: Column | None = None, line: Column | None = None, col: Column | None = None, step: int = 0) -> DataFrame:
    """The lines of each row, one after another; null ones are left out. Rows are ordered by file, line and column."""
    texts = F.array_compact(F.array(*lines))
    key = (F.lit(part).alias("part"), (F.lit("") if file is None else file).alias("file"), (F.lit(0) if line is None else line).cast("long").alias("line"), (F.lit(0) if col is None else col).cast("long").alias("col"))
    return rows.select(*key, F.posexplode(texts).alias("step", "text")).withColumn("step", F.col("step") + step)


def _sorted(*sections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sections).orderBy("part", *report.by_name(), "line", "col", "step", "text").select("text")


def _listed(parts: DataFrame, title: Column, rows: DataFrame, part: int, *lines: Column) -> list[DataFrame]:
    """A section with a title, its rows by place and an empty line; nothing without rows. parts: one row with n."""
    there = parts.where("n > 0")
    return [_section(part, there, title), _section(part + 1, rows, *lines, file=F.col("file"), line=F.col("line"), col=F.col("col")), _section(part + 2, there, F.lit(""))]


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def _tally(rows: DataFrame, key: Column | str, form: str) -> DataFrame:
    """One row: told, the keys with their counts by falling count, joined by commas. Keys are few."""
    each = rows.groupBy((F.col(key) if isinstance(key, str) else key).alias("k")).agg(F.count("*").alias("c")).select(F.struct((-F.col("c")).alias("o"), "k", _f(form, k="k", c="c").alias("t")).alias("x"))
    return each.agg(F.array_join(F.array_sort(F.collect_list("x"))["t"], ", ").alias("told"))


def _by_file(part: int, rows: DataFrame, *lines: Column) -> list[DataFrame]:
    """Rows below the names of their files, with an empty line behind each file."""
    files = rows.select("file").distinct()
    return [
        _section(part, files, _f("FILE: {file}"), file=F.col("file"), line=F.lit(FIRST)),
        _section(part, rows, *lines, file=F.col("file"), line=F.col("line"), col=F.col("col")),
        _section(part, files, F.lit(""), file=F.col("file"), line=F.lit(LAST)),
    ]


def _empty(rows: DataFrame, told: str) -> DataFrame:
    """The only line of a report without rows."""
    return _section(0, rows.agg(F.count("*").alias("n")).where("n = 0"), F.lit(told))


def colors(rows: DataFrame) -> DataFrame:
    yes, no = rows.where("actionable"), rows.where("not actionable")
    facts = report.colors_summary(rows).where("total > 0").join(_tally(rows, "type", "{k}({c})"))  # one row and one row
    head = _section(
        1, facts, F.lit(""), F.lit("=== Hardcoded Colors ==="), _f("Found {total} hardcoded color values in {files} files"),
        _f("Actionable: {actionable} | Skipped: {skipped}"), _f("Types: {told}"), F.lit(""),
    )
    hex_ = F.when(F.col("hex").isNotNull(), F.concat(F.lit(" -> "), "hex"))
    skipped = no.groupBy("label").agg(F.count("*").alias("c"), F.count_distinct("file").alias("files"))
    n = _count(no).where("n > 0")
    return _sorted(
        _empty(rows, "No hardcoded color values found."), head, *_by_file(2, yes, _f("  L{line}:{col}  {value}  ({type}{hex})", hex=hex_), _f("    {text}")),
        _section(3, n, _f("--- Skipped {n} non-actionable colors ---")), _section(4, skipped, _f("  [{label}] {c} colors in {files} files"), line=-F.col("c")), _section(5, n, F.lit("")),
    )


def tailwind(rows: DataFrame, v4: DataFrame) -> DataFrame:
    """v4: the row of commands.tailwind_v4_facts."""
    matched = rows.where("arbitrary is not null and near_name is not null")
    facts = report.tailwind_summary(rows).where("total > 0").join(v4.drop("files"))  # one row and one row
    found = F.when(F.col("arbitrary_with_match") > 0, _f(" ({arbitrary_with_match} match theme vars)"))
    head = _section(
        1, facts, F.lit(""), F.lit("=== Tailwind Color Classes ==="), _f("Found {total} Tailwind color classes in {files} files"), F.when(F.col("version") == 4, "Tailwind v4 detected"),
        F.when(F.col("arbitrary") > 0, _f("Arbitrary values: {arbitrary}{found}", found=found)), F.lit(""),
    )
    status = F.when(F.col("arbitrary_status") == "exact", "EXACT").otherwise(_f("CLOSE (dE={d})", d=_number("near_distance")))
    theme = _section(5, facts.where("version = 4 and (theme_vars > 0 or utilities > 0)"), F.lit("--- Tailwind v4 ---"), _f("  @theme variables: {theme_vars}"), _f("  @utility definitions: {utilities}"), F.lit(""))
    detail = F.when(F.col("arbitrary").isNotNull(), _f("arbitrary: {arbitrary}")).otherwise(_f("{color}-{shade}", shade=F.coalesce("shade", F.lit("default"))))
    return _sorted(
        _empty(rows, "No Tailwind color classes found."), head,
        *_listed(_count(matched), _f("--- ARBITRARY VALUES MATCHING THEME ({n}) ---"), matched, 2, _f("  {file}:{line}:{col}  {value} -> {status}: {near_name} ({near_hex})", status=status), F.when(F.col("suggestion").isNotNull(), _f("    {suggestion}"))),
        theme, *_by_file(6, rows, _f("  L{line}:{col}  {value}  ({prefix}, {detail})", detail=detail), _f("    {context}")),
    )


def compare(rows: DataFrame, palette: DataFrame, threshold: float, source: str) -> DataFrame:
    yes, no = rows.where("actionable"), rows.where("not actionable")
    label = context.context_label(F.col("context"))
    counts = rows.agg(F.count("*").alias("total"), F.count_if("actionable").alias("actionable"), F.count_if(~F.col("actionable")).alias("skipped"), *(F.count_if(F.col("actionable") & (F.col("status") == s)).alias(s) for s in report.STATUSES))
    facts = counts.where("total > 0").join(palette.agg(F.count("*").alias("entries"))).join(_tally(no, label, "{c} {k}"))  # one row each
    head = _section(
        1, facts, F.lit(""), F.lit("=== Color Variable Comparison ==="), _f("Palette: {entries} variables from {source}", source=F.lit(source)), _f("Threshold: delta-E <= {t} for close matches", t=F.regexp_replace(F.lit(float(threshold)).cast("string"), r"\.0$", "")),
        _f("Total found: {total} | Actionable: {actionable} | Skipped: {skipped}"), _f("Actionable: {exact} exact | {close} close | {unmatched} unmatched"), F.when(F.col("skipped") > 0, _f("Skipped: {told}")), F.lit(""),
    )
    place = "  {file}:{line}:{col}  {value}"
    hex_ = F.when(F.col("hex").isNotNull(), F.concat(F.lit(" -> "), "hex"))
    near = F.when(F.col("near_name").isNotNull(), _f(" (nearest: {near_name} {near_hex} dE={d})", d=_number("near_distance")))
    named = F.when(F.col("name_suggestion").isNotNull(), _f(" [suggest: {name_suggestion}]"))
    replace = F.when(F.col("suggestion").isNotNull(), _f(" | replace: {suggestion}"))
    told = {
        "unmatched": ("UNMATCHED", _f(place + "{hex}{near}{named}", hex=hex_, near=near, named=named)),
        "close": ("CLOSE MATCHES", _f(place + " -> use {near_name} ({near_hex}, dE={d}){replace}", d=_number("near_distance"), replace=replace)),
        "exact": ("EXACT MATCHES", _f(place + " -> {near_name} ({near_hex}){replace}", replace=replace)),
    }
    sections = []
    for i, (status, (title, line)) in enumerate(told.items()):
        some = yes.where(F.col("status") == status)
        sections += _listed(_count(some), _f(f"--- ACTIONABLE {title} ({{n}}) ---"), some, 2 + 3 * i, line, _f("    {text}"))
    n = _count(no).where("n > 0")
    kinds = no.groupBy("context").agg(F.count("*").alias("c"), F.count_distinct("file").alias("files")).withColumn("label", label)
    short = F.array_join(F.slice(F.split("file", "/"), -F.least(F.lit(2), F.size(F.split("file", "/"))), 2), "/")
    few = report.examples(no)
    sections += [
        _section(20, n, _f("--- SKIPPED ({n} non-actionable) ---")), _section(21, kinds, _f("  [{label}] {c} colors in {files} files"), file=F.col("context"), line=F.lit(FIRST)),
        _section(21, few, _f("    e.g. {short}:{line}  {value}", short=short), file=F.col("context"), line=F.col("rank")), _section(21, kinds.where("c > 3"), _f("    ... and {more} more", more=F.col("c") - 3), file=F.col("context"), line=F.lit(LAST)), _section(22, n, F.lit("")),
    ]
    return _sorted(_empty(rows, "No hardcoded colors found to compare."), head, *sections)


def patterns(lists: DataFrame, min_count: int = 2, min_classes: int = 2) -> DataFrame:
    """Patterns by falling impact, each with its places; they aren't numbered."""
    found = commands.patterns(lists, min_count)
    facts = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))
    places = commands.pattern_locations(lists, min_count)
    kinds = places.groupBy("pattern").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    each = found.join(kinds, "pattern")
    head = [F.lit(""), F.lit("=== Repeated Class Patterns ==="), _f("Found {n} repeated patterns across {places} locations"), F.lit(f"Criteria: >={min_count} occurrences, >={min_classes} classes"), F.lit("")]
    sources = F.when((F.size("sources") > 1) | F.array_contains("sources", "cn/clsx"), F.concat(F.lit("   Sources: "), F.array_join("sources", ", ")))
    about = [_f('"{pattern}"'), _f("   Classes: {class_count} | Occurrences: {n} | Impact score: {impact}"), sources, F.lit("   Consider: CVA variant, @apply directive, or component extraction"), F.lit("   Locations:")]
    at = [_f("     {file}:{line}:{col}{tag}", tag=F.when(F.col("source") == "cn/clsx", " [cn/clsx]")), F.when(F.col("original") != F.col("pattern"), _f('       original: "{original}"'))]
    # sorted by impact and pattern first, then by place; a pattern's own lines stand before and behind its places
    def keyed(part: int, rows: DataFrame, lines: list[Column], where: int, pattern: Column, o: Column, *at: Column) -> DataFrame:
        path, line, col = at or (F.lit(""), F.lit(0), F.lit(0))
        own = (F.lit(part).alias("part"), o.cast("long").alias("_o"), pattern.alias("pattern"), F.lit(where).alias("where"), path.alias("file"), line.cast("long").alias("line"), col.cast("long").alias("col"))
        return rows.select(*own, F.posexplode(F.array_compact(F.array(*lines))).alias("step", "text"))

    name, by = F.col("pattern"), -F.col("impact")
    titles, ends = keyed(2, each, about, 0, name, by), keyed(2, found, [F.lit("")], 2, name, by)
    listed = keyed(2, places.join(found.select("pattern", "impact"), "pattern"), at, 1, name, by, F.col("file"), F.col("line"), F.col("col"))
    plain = lambda part, rows, *lines: keyed(part, rows, list(lines), 0, F.lit(""), F.lit(0))
    some = facts.where("n > 0")
    subsets, pairs = commands.subset_relations(lists, min_count), commands.class_pairs(lists, min_count)
    base = [_f('  Base: "{subset}" ({subset_count}x)'), _f('    is subset of: "{superset}" ({superset_count}x)'), F.concat(F.lit("    extra classes: "), F.array_join(F.split("extra", " "), ", ")), F.lit("")]
    any_of = lambda rows: rows.agg(F.count("*").alias("n")).where("n > 0")
    parts = [
        plain(0, facts.where("n = 0"), F.lit(f"No repeated class patterns found (min {min_count} occurrences, min {min_classes} classes).")), plain(1, some, *head), titles, listed, ends,
        plain(3, any_of(subsets), F.lit("--- Subset Relationships ---"), F.lit("These patterns share a common base that could be extracted:"), F.lit("")), keyed(4, subsets, base, 0, F.concat("subset", F.lit(" < "), "superset"), F.lit(0)),
        plain(5, any_of(pairs), F.lit("--- Frequently Co-occurring Class Pairs ---"), F.lit("These class pairs appear together often and may form a logical group:"), F.lit("")), keyed(6, pairs, [_f('  "{pair}" ({n} co-occurrences)')], 0, F.col("pair"), -F.col("n")), plain(7, any_of(pairs), F.lit("")),
        plain(
            8, some, F.lit("TIP: Use class-variance-authority (CVA) to create typed variants from repeated patterns."), F.lit("TIP: Use tailwind-merge to simplify conflicting/duplicate Tailwind classes."),
            F.lit("TIP: Consider extracting patterns into @apply directives or shared components."), F.lit(""),
        ),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("part", "_o", "pattern", "where", *report.by_name(), "line", "col", "step", "text").select("text")


def told(lines: DataFrame) -> Iterator[str]:
    """The lines of a report in order; the driver holds those of one partition."""
    return (row.text for row in lines.toLocalIterator())
