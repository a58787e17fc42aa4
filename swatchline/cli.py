"""The reports over a file tree: python -m swatchline.cli COMMAND [PATH...] [options]."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from swatchline.plans import commands, report, text
from swatchline.sources import options
from swatchline.sources.lines import read_tree
from swatchline.sources.palette import read_palette

COMMANDS = ("colors", "tailwind", "compare", "patterns")


def rows_of(spark: SparkSession, command: str, paths: list[str], o: options.Options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(lines, rows of the report, palette) of a command by its options."""
    lines = read_tree(spark, paths, o.include, o.exclude)
    palette = read_palette(spark, o.vars) if o.vars else None
    threshold = commands.option_number(o.threshold, 10)
    if command == "colors":
        return lines, commands.colors(lines, o.named), palette
    if command == "tailwind":
        return lines, commands.tailwind(lines, palette, threshold), palette
    if command == "compare":
        if palette is None:
            raise SystemExit(f"compare needs a file of variables; there is none at {o.vars}")
        return lines, commands.compare(lines, palette, threshold), palette
    least, classes = _minima(o)
    return lines, commands.patterns(commands.class_lists(lines, classes), least), palette


def version_of(lines: DataFrame, paths: list[str], o: options.Options) -> DataFrame:
    """The row of the Tailwind version; an option other than auto decides it."""
    found = commands.tailwind_v4_facts(lines, paths)
    return found if str(o.tailwind_version) == "auto" else found.selectExpr(f"{int(o.tailwind_version)} AS version", "theme_vars", "utilities", "files")


def _minima(o: options.Options) -> tuple[int, int]:
    return commands.option_integer(o.min_count, 2), commands.option_integer(o.min_classes, 2)


def document(command: str, lines: DataFrame, rows: DataFrame, palette: DataFrame | None, paths: list[str], o: options.Options) -> DataFrame:
    if command == "colors":
        return report.colors_document(rows)
    if command == "tailwind":
        return report.tailwind_document(rows, version_of(lines, paths, o))
    if command == "compare":
        return report.compare_document(rows, palette, commands.option_number(o.threshold, 10))
    least, classes = _minima(o)
    return report.patterns_document(commands.class_lists(lines, classes), least, classes)


def text_lines(command: str, lines: DataFrame, rows: DataFrame, palette: DataFrame | None, paths: list[str], o: options.Options) -> DataFrame:
    """The report for people, as its lines in order."""
    if command == "colors":
        return text.colors(rows)
    if command == "tailwind":
        return text.tailwind(rows, version_of(lines, paths, o))
    if command == "compare":
        return text.compare(rows, palette, commands.option_number(o.threshold, 10), os.path.basename(o.vars))
    least, classes = _minima(o)
    return text.patterns(commands.class_lists(lines, classes), least, classes)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="swatchline", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--include")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--vars")
    p.add_argument("--threshold", default=10)
    p.add_argument("--no-named", dest="named", action="store_false")
    p.add_argument("--min-count", default=2)
    p.add_argument("--min-classes", default=2)
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--json", action="store_true", help="as --format json")
    p.add_argument("--out", help="a new folder for the report; without it, it is printed")
    p.add_argument("--baseline", help="save the rows of compare here")
    p.add_argument("--diff", help="only rows of compare that this baseline lacks")
    p.add_argument("--fix", metavar="FOLDER", help="write changed files below this new folder")
    p.add_argument("--output-schema", action="store_true", help="print the columns of the report and end")
    a = p.parse_args(args)
    if a.output_schema:
        print(report.SCHEMAS[a.command].replace(", ", "\n"))
        return
    given = options.Options(include=a.include, exclude=a.exclude, vars=a.vars, threshold=commands.option_number(a.threshold, 10), named=a.named, min_count=commands.option_integer(a.min_count, 2), min_classes=commands.option_integer(a.min_classes, 2), format="json" if a.json else a.format)
    o = options.merge(given, options.load(a.paths[0]))
    o = replace(o, named=a.named and o.named)
    spark = spark or SparkSession.builder.appName("swatchline").getOrCreate()
    lines, rows, palette = rows_of(spark, a.command, a.paths, o)
    if a.command == "compare":
        if a.baseline:
            commands.save_baseline(rows, a.baseline)
        old = commands.read_baseline(spark, a.diff) if a.diff else None
        if old is not None:
            new, known = commands.diff_counts(rows, old)
            print(f"Diff: {new} new issues ({known} already in baseline)\n")
            rows = commands.diff(rows, old)
        if a.fix:  # then nothing is reported
            print(f"Fixed {commands.write_fixed(lines, rows, a.fix)} exact matches with var() replacements.")
            return
    as_text = o.format != "json"
    parts = text_lines(a.command, lines, rows, palette, a.paths, o) if as_text else document(a.command, lines, rows, palette, a.paths, o)
    if a.out:
        parts.write.text(a.out) if as_text else parts.write.json(a.out)
        return
    for line in text.told(parts) if as_text else (row.value for row in report.as_json(parts).toLocalIterator()):
        print(line)


if __name__ == "__main__":
    main()
