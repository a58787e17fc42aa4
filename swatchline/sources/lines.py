"""Source text as lines (file, line, text): from a file tree, or projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchline import dims


def glob_regex(glob: str) -> str:
    """A gitignore-like glob as a regular expression on a path: **, *, ?, {a,b}; without a slash it fits any depth."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c
        i += 1
    return f"(?:^|/){out}$" if "/" not in glob.rstrip("/") else f"(?:^|/){out.lstrip('/')}$"


def selected(lines: DataFrame, include: str | None = None, exclude: list[str] | str | None = None) -> DataFrame:
    """Lines of files that fit: the include glob replaces the default extensions; excludes and built-in excludes drop."""
    name = F.col("file")
    fits = name.rlike(glob_regex(include)) if include else name.rlike(r"(?i)\.(" + "|".join(dims.EXTENSIONS) + ")$")
    for glob in [exclude] if isinstance(exclude, str) else exclude or []:
        fits = fits & ~name.rlike(glob_regex(glob))
    return lines.where(fits & ~name.rlike(dims.EXCLUDED))


#: Splits of files whose counts are broadcast; beyond that they are joined by file and split.
MOST_SPLITS = 200_000


def read_raw(spark: SparkSession, paths: list[str], include: str | None = None, exclude: list[str] | str | None = None) -> DataFrame:
    """file, line, raw, ending: every line of the files below the paths that are selected, byte for byte.

    raw is the line as it stands, with its carriage return and blanks, and a byte order mark in front of the first;
    ending is the line feed, or nothing behind a last line that has none. A missing path raises, as Spark's reader does.

    Files are read in splits, so a file of any size is many rows on many tasks. A line's number is its place in its split
    and the lines of the file's splits before, which one more scan counts: a row for each split. Splits are told by the
    reader's own bounds, and a line's place by an id that rises within a split. That id also keeps later filters from
    being pushed into one of the two scans, so both have the same splits.
    """
    meta = "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start"
    texts = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths).select("value", *(F.col(m).alias(a) for m, a in zip(meta, ("_path", "_size", "_at"), strict=True)))
    # paths are told as URLs; a plus sign in them is no blank
    name = F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B")))
    texts = selected(texts.withColumn("file", F.regexp_replace(name, "^file:(//)?", "")), include, exclude)
    rows = texts.select("file", "_size", "_at", "value", F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.any_value("_size").alias("_size"))
    before, whole = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # what the lines and their ends leave of the file's bytes: a mark at its start is not told, a last end may be missing
    left = F.col("_size") - F.sum("_bytes").over(whole)
    splits = splits.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_lines"), left.isin(2, 3).alias("_mark"), left.isin(-1, 2).alias("_open"))
    bounded = len(texts.inputFiles()) + texts.rdd.getNumPartitions() <= MOST_SPLITS
    rows = rows.drop("_size").join(F.broadcast(splits) if bounded else splits, ["file", "_at"])
    line = (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int")
    rows = rows.select("file", line.alias("line"), "value", "_lines", "_mark", "_open")
    raw = F.when(F.col("_mark") & (F.col("line") == 1), F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))
    return rows.select("file", "line", raw.alias("raw"), F.when(F.col("_open") & (F.col("line") == F.col("_lines")), "").otherwise("\n").alias("ending"))


def read_tree(spark: SparkSession, paths: list[str], include: str | None = None, exclude: list[str] | str | None = None) -> DataFrame:
    """file, line, text and the columns of read_raw: text is the line without white space at its end."""
    rows = read_raw(spark, paths, include, exclude)
    return rows.select("file", "line", F.regexp_replace("raw", f"{dims.SPACE}+$", "").alias("text"), "raw", "ending")


#: Lines of the projected tree; {H} is a hex from the keys, {P} a palette colour, {N} one near it.
TEMPLATES = [
    "  color: #{H};", "  background-color: #{P};", "  border-color: #{N};", "  border: 1px solid #{P};", "  --color-x: #{P};",
    "  box-shadow: 0 0 4px rgba(0, 0, 0, 0.1);", "  background: rgba(255, 255, 255, 0.5);", "  color: rgb(200 10 30 / 50%);", "  color: rgb(50%, 0, 0);", "  color: hsl(220, 90%, 56%);",
    "  fill: hsla(0.5turn 100% 50%);", "  color: oklch(0.5 0.2 240);", "  color: color(display-p3 1 0 0);", "  color: rgb(1, 2 3);", "  color: rgb(300, 0, 0);",
    "  color: coral;", "  style={{ color: 'teal' }}", "  borderColor: 'Tomato',", "// color: #{H}", " * note #{P}",
    "/* start #{H}", "end */ color: #{P};", "/* a */ x /* b", "*/ y /*", "const c = `<b>${x} #{H}</b>`;",
    "<meta name=\"theme-color\" content=\"#{P}\" />", "  '#{H}': 'label',", "  'key: #{H}': 'value',", "  css: '#{P}',", "const v = getCssVar('--x') || '#{H}';",
    "const w = x || '#{P}';", "  text-shadow: 1px 1px #000;", "  a: string #{H}", "  fill: '#{P}80', stroke: '#{N}'", "&#8217; quote #12345 #1234567",
    "<div className=\"bg-red-500 text-white p-2\">", "<div class='bg-red-500 text-white p-2'>", "<p className=\"border-gray-200/50 p-2 text-white\">", "cn(\"flex items-center gap-2\", x)", "clsx('p-2 text-white', y && 'm-1 text-black')",
    "<i className=\"bg-[#{P}] text-[14px] BG-RED-500 BG-BLACK\">", "<b class=\"ring-[#{N}] from-[#{H}] bg-[]\">", "@theme {", "  --color-brand: #{P};", "}",
    "@utility tab-x { a: b }", "import * as t from 'three';", "const t = createTheme({});", "  color: #{P}; background: #{N}; border: #{H}", "  ${a} #{H}",
    "\t--color-y: #{H};", "  box-shadow: 0 0 2px RGBA(0, 0, 0, 0.1);", "<hr className=\"\t\"><hr class='\tp-4 m-4\t'>",
]
FILES = ["src/components/C{u}.tsx", "src/styles/s{u}.css", "src/theme/t{u}.ts", "src/u{u}/ColorMapper.tsx", "public/p{u}.html", "node_modules/x{u}/index.js", "src/app{u}/globals.css", "src/pages/g{u}.tsx", "docs/d{u}.md", "src/plain/f{u}.jsx"]


def _hex6(c):
    return F.lpad(F.lower(F.hex(c)), 6, "0")


def src_lines(events: DataFrame) -> DataFrame:
    """A tree of source lines made of the events table, the same in any SQL engine."""
    h = (F.col("event_id") * 7919 + F.col("user_id") * 104729) % 16777216
    p = ((F.col("event_id") % 39 + 1) * 424243) % 16777216
    near = p - p % 256 + (p % 256 + 3) % 256
    k = (F.col("event_id") + F.col("user_id")) % len(TEMPLATES)
    family = F.col("user_id") % len(FILES)
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (k + 1).cast("int"))
    # a canvas import or theme builder stays in one file family in which users of multiples of 7 have it
    text = F.when(k.isin(46, 47) & (F.col("user_id") % 7 != 0), "plain").otherwise(text)
    for mark, c in (("{H}", h), ("{P}", p), ("{N}", near)):
        text = F.replace(text, F.lit(mark), _hex6(c))
    name = F.replace(F.element_at(F.array(*map(F.lit, FILES)), (family + 1).cast("int")), F.lit("{u}"), F.col("user_id").cast("string"))
    line = F.row_number().over(Window.partitionBy("file").orderBy("event_id"))
    return events.select(name.alias("file"), "event_id", text.alias("text")).select("file", line.alias("line"), "text")


def part_palette(part: DataFrame) -> DataFrame:
    """A palette of 39 entries made of the part table: (ord, name, hex)."""
    kind = F.element_at(F.array(*map(F.lit, ("color", "bg", "text", "border"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.where("p_partkey between 1 and 39").select(F.col("p_partkey").cast("int").alias("ord"), F.concat(F.lit("--"), kind, F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("#"), _hex6((F.col("p_partkey") * 424243) % 16777216)).alias("hex"))
