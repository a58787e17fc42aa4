import math

import pytest
from pyspark.sql import functions as F

from swatchline.functions import color
from swatchline.operators import context, extract, match
from swatchline.plans import commands, report, text
from swatchline.sources import options, palette
from swatchline.sources.lines import glob_regex


def lines(spark, *texts, file="src/a.tsx"):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "file string, line int, text string")


def pal(spark, *pairs):
    return spark.createDataFrame([(i, n, h) for i, (n, h) in enumerate(pairs)], "ord int, name string, hex string")


@pytest.mark.parametrize(
    ("value", "want"),
    [("#fff", "#ffffff"), ("#1234567", "#123456"), ("rgb(300, 0, 0)", "#ff0000"), ("rgb(50%, 0, 0)", "#7f0000"), ("rgb(1, 2 3)", None), ("hsl(220, 90%, 56%)", "#2a6df4"), ("oklch(0.5 0.2 240)", None), ("Coral", "#ff7f50")],
)
def test_normalised(spark, value, want):
    rows = spark.createDataFrame([(value,)], "v string")
    assert rows.select(color.to_hex(color.parse_color(F.col("v")))).first()[0] == want


@pytest.mark.parametrize(("a", "b", "want"), [("#ff0000", "#0000ff", 176.31), ("#000000", "#ffffff", 100.0), ("#475569", "#4b5563", 3.90), ("#10b981", "#10b982", 0.56)])
def test_distance(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    lab = [color.to_lab(color.parse_color(F.col(c))) for c in "ab"]
    assert math.isclose(rows.select(color.round2(color.distance(*lab))).first()[0], want, abs_tol=0.005)


@pytest.mark.parametrize(("value", "want"), [("#00000080", 0.5), ("#fff", None), ("rgba(1,2,0)", 0.0), ("rgba(0,0,0,50%)", None), ("rgb(0,0,0,.5)", None), ("rgb(0 0 0 / 50%)", 0.5)])
def test_alpha(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(color.alpha(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "entries", "want"),
    [
        ("x: #00ff00", [("--a", "#00fe00"), ("--b", "#00ff00")], ("--a", "close")),
        ("x: #00ff00", [("--b", "#00ff00"), ("--a", "#00fe00")], ("--b", "exact")),
        ("color: #00ff00", [("--b", "#00ff00"), ("--text-a", "#00fe00")], ("--text-a", "close")),
    ],
)
def test_semantic_fold(spark, text, entries, want):
    row = commands.compare(lines(spark, text), pal(spark, *entries)).first()
    assert (row.near_name, row.status) == want


def test_categories(spark):
    names = ["border-color", "outline-color", "background-color", "box-shadow", "border", "fill"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(match.category(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["text", "text", "background", "shadow", None, "fill"]


def test_block_comments_against_state_machine(spark):
    import random

    random.seed(3)
    texts = ["".join(random.choice(["/*", "*/", " x ", "a"]) for _ in range(random.randint(0, 5))) for _ in range(400)]
    inside, want = False, []
    for t in texts:
        before = inside
        start = t.find("/*")
        opens = start >= 0 and "*/" not in t[start + 2 :]
        closes = "*/" in t
        inside = (not inside) if opens and closes else True if opens else False if closes else inside
        want.append(before or inside)
    got = [r.in_block for r in context.block_comments(lines(spark, *texts)).orderBy("line").collect()]
    assert got == want


def test_colors_and_columns(spark):
    rows = commands.colors(lines(spark, "é #fff", "a: string #fff", "// #000", "  color: red;", "box-shadow: 0 0 rgba(0, 0, 0, 0.1)")).orderBy("line").collect()
    assert [(r.line, r.col, r.value, r.context) for r in rows] == [(1, 4, "#fff", "actionable"), (4, 3, "red", "actionable"), (5, 17, "rgba(0, 0, 0, 0.1)", "effect")]


def test_patterns(spark):
    lists = commands.class_lists(lines(spark, 'cn("a-b c-d")', '<p className="a a b">'))
    assert {(r.pattern, r.n, r.class_count) for r in commands.all_patterns(lists).collect()} == {("a-b c-d", 2, 2), ("a a b", 1, 3)}


def test_tailwind(spark):
    rows = commands.tailwind(lines(spark, "BG-BLACK BG-RED-500 bg-[] text-[14px] bg-[#ff0000]"), pal(spark, ("--r", "#ff0000"))).orderBy("col").collect()
    assert [(r.value, r.arbitrary_status) for r in rows] == [("BG-RED-500", None), ("text-[14px]", None), ("bg-[#ff0000]", "exact")]


def test_diff_and_fix(spark):
    p = pal(spark, ("--r", "#ff0000"))
    src = lines(spark, "color: #ff0000; fill: #ff0000", "color: oklch(0.5 0.2 240)")
    rows = commands.compare(src, p)
    assert commands.diff(rows, commands.baseline(rows)).count() == 0
    assert commands.fixed_lines(src, rows).first().text == "color: var(--r); fill: var(--r)"
    assert report.compare_summary(rows).first().exact == 2
    assert "Actionable: 2 exact | 0 close | 1 unmatched" in list(text.told(text.compare(rows, p, 10, "t.css")))


def test_palettes(spark, tmp_path):
    css = palette.from_css(spark, ":root { --a: #fff; --b: rgb(1, 2, 3); --a: #000; --c: nothing }").orderBy("ord").collect()
    assert [(r.name, r.hex) for r in css] == [("--a", "#000000"), ("--b", "#010203")]
    js = palette.from_json(spark, '{"x": {"500": "#fff", "50": "red"}, "7": "#000", "n": 1}').orderBy("ord").collect()
    assert [(r.name, r.hex) for r in js] == [("7", "#000000"), ("x.500", "#ffffff"), ("x.50", "#ff0000")]
    (tmp_path / "t.js").write_text("export const c = { primary: '#123456' }")
    assert palette.read_palette(spark, str(tmp_path / "t.js")).first().name == "primary"
    assert palette.read_palette(spark, str(tmp_path / "none.css")) is None


def test_tree_and_options(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from swatchline.sources.lines import read_tree

    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("#fff")
    (tmp_path / "a.css").write_text("a {\n  color: #fff;  \n}")
    rows = read_tree(spark, [str(tmp_path)]).orderBy("line").collect()
    assert [(r.line, r.text) for r in rows] == [(1, "a {"), (2, "  color: #fff;"), (3, "}")]
    with pytest.raises(AnalysisException):
        read_tree(spark, [str(tmp_path / "missing")]).count()
    import re

    assert re.search(glob_regex("*.{css,html}"), "src/a.css") and not re.search(glob_regex("**/theme/**"), "src/a.css")
    (tmp_path / ".swatchlinerc").write_text('{"threshold": 5, "exclude": ["x"], "minCount": 4}')
    merged = options.merge(options.Options(min_count=3), options.load(str(tmp_path / "node_modules")))
    assert (merged.threshold, merged.exclude, merged.min_count) == (5, ["x"], 3)
    assert [commands.option_number(x, 10) for x in ("0", "10px", "x", None, 5, ".5e1 ")] == [10, 10, 10, 10, 5, 5]


PALETTE = [
    ("--color-primary", "#667eea"), ("--color-secondary", "#764ba2"), ("--color-danger", "#ff0000"), ("--color-white", "#ffffff"), ("--color-dark", "#1a1a2e"),
    ("--color-gray-200", "#e5e7eb"), ("--color-blue-100", "#dbeafe"), ("--color-blue-800", "#1e40af"), ("--color-text", "#333333"),
]


def test_compare_rows_pinned(spark):
    src = lines(
        spark, "x = { color: '#ff0000' }", "x = { boxShadow: '0 1px rgba(0, 0, 0, 0.1)' }", "x = { backgroundColor: '#dbeafe' }", "grad(#667eea, #764ba2)", "    color: hsl(220, 90%, 56%)",
        "x = { background: '#1a1a2e' }", "    color: rgb(200, 200, 210)", "    background: oklch(0.5 0.2 240)", "  style={{ color: 'coral' }}", "x = { boxShadow: '0 1px RGBA(0, 0, 0, 0.1)' }",
    )
    rows = commands.compare(src, pal(spark, *PALETTE)).orderBy("line", "col").collect()
    assert [(r.line, r.value, r.type, r.hex, r.context, r.status, r.near_name, r.near_distance, r.suggestion, r.name_suggestion) for r in rows] == [
        (1, "#ff0000", "hex", "#ff0000", "actionable", "exact", "--color-danger", 0.0, "var(--color-danger)", None),
        (2, "rgba(0, 0, 0, 0.1)", "rgba", "#000000", "effect", "unmatched", "--color-dark", 17.94, None, None),
        (3, "#dbeafe", "hex", "#dbeafe", "actionable", "exact", "--color-blue-100", 0.0, "var(--color-blue-100)", None),
        (4, "#667eea", "hex", "#667eea", "actionable", "exact", "--color-primary", 0.0, "var(--color-primary)", None),
        (4, "#764ba2", "hex", "#764ba2", "actionable", "exact", "--color-secondary", 0.0, "var(--color-secondary)", None),
        (5, "hsl(220, 90%, 56%)", "hsl", "#2a6df4", "actionable", "unmatched", "--color-primary", 18.1, None, "--text-blue-500"),
        (6, "#1a1a2e", "hex", "#1a1a2e", "actionable", "exact", "--color-dark", 0.0, "var(--color-dark)", None),
        (7, "rgb(200, 200, 210)", "rgb", "#c8c8d2", "actionable", "unmatched", "--color-gray-200", 11.23, None, "--text-gray-light"),
        (8, "oklch(0.5 0.2 240)", "oklch", None, "actionable", "unmatched", None, None, None, "--color-custom"),
        (10, "RGBA(0, 0, 0, 0.1)", "rgba", "#000000", "effect", "unmatched", "--color-dark", 17.94, None, None),
    ]


@pytest.mark.parametrize(
    ("file", "text", "value", "want"),
    [
        ("a.css", "\t--color-x: #fff;", "#fff", "css-definition"), ("src/theme/x.ts", "a: '#fff'", "#fff", "theme-definition"), ("src/theme/x.ts", "a: var(--b, #fff)", "#fff", "actionable"),
        ("ColorMapper.tsx", "a '#fff'", "#fff", "mapping"), ("a.html", '<meta name="theme-color" content="#fff">', "#fff", "meta"), ("a.ts", "`<b>${x} #fff</b>`", "#fff", "generated"),
        ("a.ts", "x || '#fff'", "#fff", "canvas"), ("a.css", "box-shadow: 0 0 #000", "#000", "effect"), ("a.css", "color: #000", "#000", "actionable"), ("a.css", "x RGB(0 0 0 / 10%)", "RGB(0 0 0 / 10%)", "effect"),
        ("a.css", "x rgb(0, 0, 0)", "rgb(0, 0, 0)", "actionable"),
    ],
)
def test_contexts(spark, file, text, value, want):
    got = {r.value: r.context for r in commands.compare(lines(spark, text, file=file), pal(spark, ("--a", "#123456"))).collect()}
    assert got == {value: want}


def test_places_count_once(spark):
    twice = lines(spark, "color: #fff").unionAll(lines(spark, "color: #fff"))
    assert commands.compare(twice, pal(spark, ("--a", "#fff"))).count() == commands.colors(twice).count() == 1


def test_white_space_is_trimmed(spark):
    lists = commands.class_lists(lines(spark, '<a className="\t">', "<a class=' p-2 m-1\t'>")).collect()
    assert [(r.classes, r.tokens) for r in lists] == [("p-2 m-1", ["p-2", "m-1"])]


def test_theme_only_in_roots(spark):
    rows = lines(spark, "@theme {", "  --color-a: #fff;", "}", file="src/deep/globals.css")
    assert commands.tailwind_v4(rows, ["src"]).first()[:2] == (3, 0)
    assert commands.tailwind_v4(rows, ["src/deep/"]).first()[:2] == (4, 1)
    assert commands.tailwind_v4(rows, ["src/deep/globals.css"]).first()[:2] == (4, 1)


@pytest.mark.parametrize(
    ("given", "config", "want"),
    [
        ({"format": "json", "threshold": 5, "exclude": ["a"]}, {"format": "text", "threshold": 10, "exclude": ["b"]}, {"format": "json", "threshold": 5, "exclude": ["a"]}),
        ({}, {"exclude": ["a"], "include": "*.tsx", "vars": "t.css"}, {"exclude": ["a"], "include": "*.tsx", "vars": "t.css"}),
        ({}, {}, {"format": "text", "threshold": 10}),
        ({}, {"json": True}, {"format": "json"}),
        ({"format": "json"}, {"json": True}, {"format": "json"}),
        ({}, {"format": "json"}, {"format": "text"}),
        ({}, {"named": False}, {"named": False}),
        ({}, {"threshold": 5}, {"threshold": 5}),
        ({}, {"minCount": 3, "minClasses": 4}, {"min_count": 3, "min_classes": 4}),
        ({"tailwind_version": 3}, {"tailwindVersion": 4}, {"tailwind_version": 4}),
        ({}, {"exclude": "a"}, {"exclude": ["a"]}),
    ],
)
def test_option_merge(given, config, want):
    merged = options.merge(options.Options(**given), config)
    assert {k: getattr(merged, k) for k in want} == want


def test_locations_and_order(spark):
    src = lines(spark, '  <p className="p-2 m-1">', "<b class='m-1 p-2'>", '<i className="a-1 b-2 c-3"><i className="a-1 b-2 c-3">')
    lists = commands.class_lists(src)
    got = commands.pattern_locations(lists).orderBy("line", "col").collect()
    assert [(r.pattern, r.line, r.col, r.original, r.context, r.source) for r in got][:2] == [("m-1 p-2", 1, 6, "p-2 m-1", '<p className="p-2 m-1">', "className"), ("m-1 p-2", 2, 4, "m-1 p-2", "<b class='m-1 p-2'>", "className")]
    assert [r.pattern for r in report.ordered("patterns", commands.patterns(lists)).collect()] == ["a-1 b-2 c-3", "m-1 p-2"]
    parts = {(r.section, r.part): r.value for r in report.patterns_document(lists).collect()}
    assert '"totalPatterns":2' in parts["summary", None] and '"impactScore":6' in parts["patterns", "a-1 b-2 c-3"]


def plan_of(rows) -> str:
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_class_lists_in_one_pass(spark):
    src = lines(spark, "<p className='a b' class=\"c  d\">", 'cn("e-f g-h", x ? "" : "i")')
    lists = commands.class_lists(src)
    assert sorted((r.line, r.col, r.classes, r.source) for r in lists.collect()) == [(1, 4, "a b", "className"), (1, 20, "c  d", "className"), (2, 1, "e-f g-h", "cn/clsx"), (2, 1, "e-f g-h", "cn/clsx")]
    assert "Union" not in plan_of(lists)


def test_patterns_document_groups_lists_once(spark):
    rows = report.patterns_document(commands.class_lists(lines(spark, "<p class='a b'>", "<p class='b a c'>", "<p class='a b'>", "<p class='c b a'>")))
    assert {r.section for r in rows.collect()} == {"summary", "patterns", "locations", "subsetRelations", "frequentSubsets"}
    assert plan_of(rows).count("Generate inline") == 2  # for the patterns, and for the places


def test_semantic_match_is_the_ordered_fold(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(5)
    # entries whose distances follow each other in short steps, so that order and names decide
    shades = ["#%02x%02x%02x" % tuple(rng.randint(100, 103) for _ in "rgb") for _ in range(40)] + ["#000000", "#ffffff"]
    p = pal(spark, *((f"--{rng.choice(['bg', 'text', 'x'])}-{i}", h) for i, h in enumerate(shades)))
    tried = spark.createDataFrame([(h, c) for h, c in itertools.product(shades[:8] + ["#656565", "#808080", "none"], ["background", "text", None])], "hex string, cat string")
    tried = tried.withColumn("lab", color.to_lab(color.parse_color(F.col("hex"))))
    entries = [r for r in match.palette_lab(p).orderBy("ord").collect()]

    def fold(lab, cat):
        best = (math.inf, 0, None)
        for e in entries:
            d = math.sqrt(sum((x - y) ** 2 for x, y in zip(lab, e.lab, strict=True)))
            s = int(f"--{ {'background': 'bg'}.get(cat, cat) }-" in e.name)
            if d < best[0] - 0.5 or abs(d - best[0]) <= 0.5 and s > best[1]:
                best = (d, s, e.name)
        return best[2]

    want = {(r.hex, r.cat): fold(r.lab, r.cat) if r.lab else None for r in tried.collect()}
    assert len(set(want.values())) > 5
    for few in (256, 3):  # by row, and by distinct colour
        monkeypatch.setattr(match, "FEW_ENTRIES", few)
        assert {(r.hex, r.cat): r.near_name for r in match.nearest_semantic(tried, p).collect()} == want
    monkeypatch.undo()
    # a filter on what the match told doesn't match anew
    assert plan_of(match.nearest_semantic(tried, p).where("near_distance > 1")).count("sort_array") == 1


def test_compare_moves_hits_once(spark):
    rows = commands.compare(lines(spark, "color: #ff0000; fill: #ff0001"), pal(spark, ("--r", "#ff0000")))
    assert [(r.col, r.status) for r in rows.orderBy("col").collect()] == [(8, "exact"), (23, "close")]
    plan = plan_of(rows)
    assert "hashpartitioning(file" in plan and "hashpartitioning(file, line" not in plan.replace("#", "").replace("L,", ",") and "lab" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_compare_document_works_the_report_out_twice(spark):
    rows = commands.compare(lines(spark, "color: #ff0000;", "// x", "color: rgba(1,2,3,.5);", "box-shadow: 0 0 rgba(0, 0, 0, 0.1);"), pal(spark, ("--r", "#ff0000")))
    document = report.compare_document(rows, pal(spark, ("--r", "#ff0000")), 10)
    parts = {(r.section, r.part): r.value for r in document.collect()}
    assert '"total":3,"actionable":2,"skipped":1' in parts["summary", None] and ("actionable", "exact") in parts and parts["skippedByContext", "effect"] == "1"
    assert plan_of(document).count("Window [row_number()") == 2
    empty = report.compare_document(rows.where("false"), pal(spark, ("--r", "#ff0000")), 10).where("section = 'summary'").first().value
    assert '"total":0' in empty and '"exact":0' in empty


def test_class_pairs_need_frequent_classes(spark):
    lists = commands.class_lists(lines(spark, '<p className="a a a b">', '<p className="a a a b">'))
    assert commands.class_pairs(lists, 3).where("pair = 'a b'").count() == 0
    assert commands.class_pairs(lists, 2).where("pair = 'a b'").first().n == 6


def test_baseline_and_fixed_files(spark, tmp_path):
    src = lines(spark, "color: #ff0000;", "b", "fill: #00ff00")
    rows = commands.compare(src, pal(spark, ("--r", "#ff0000")))
    commands.save_baseline(rows.where("line = 1"), str(tmp_path / "base"))
    assert [r.line for r in commands.since_baseline(rows, str(tmp_path / "base")).collect()] == [3]
    (tmp_path / "bad.json").write_text("{not json")
    for bad in ("bad.json", "none"):
        with pytest.warns(UserWarning):
            assert commands.since_baseline(rows, str(tmp_path / bad)).count() == 2
    assert commands.write_fixed(src, rows, str(tmp_path / "fixed")) == 1
    assert commands.fixed_files(src, rows).first().content == "color: var(--r);\nb\nfill: #00ff00"


def test_command_line(spark, tmp_path, capsys):
    from swatchline import cli

    (tmp_path / "a.css").write_text("a {\n  color: #ff0000;\n  fill: rgb(1, 2, 3);\n}\n")
    (tmp_path / "v.css").write_text(":root { --r: #ff0000; }")
    css, pal_ = str(tmp_path / "a.css"), str(tmp_path / "v.css")
    cli.main(["compare", css, "--vars", pal_, "--fix", str(tmp_path / "out"), "--baseline", str(tmp_path / "base")], spark)
    assert capsys.readouterr().out == "Fixed 1 exact matches with var() replacements.\n"  # and no report
    cli.main(["compare", css, "--vars", pal_, "--diff", str(tmp_path / "base"), "--json", "--out", str(tmp_path / "doc")], spark)
    assert capsys.readouterr().out == "Diff: 0 new issues (2 already in baseline)\n\n"
    assert spark.read.json(str(tmp_path / "doc")).where("section = 'actionable'").count() == 0
    cli.main(["compare", css, "--vars", pal_, "--threshold", "5"], spark)
    assert capsys.readouterr().out.splitlines()[1:8] == [
        "=== Color Variable Comparison ===", "Palette: 1 variables from v.css", "Threshold: delta-E <= 5 for close matches", "Total found: 2 | Actionable: 2 | Skipped: 0", "Actionable: 1 exact | 0 close | 1 unmatched", "", "--- ACTIONABLE UNMATCHED (1) ---",
    ]
    cli.main(["patterns", css, "--min-count", "10px"], spark)
    assert "(min 10 occurrences, min 2 classes)" in capsys.readouterr().out
    cli.main(["colors", "--output-schema"], spark)
    assert "actionable boolean" in capsys.readouterr().out


def test_texts_by_file(spark):
    src = lines(spark, "color: #fff; fill: #000", "box-shadow: 0 0 rgba(0, 0, 0, 0.1)", file="é.css").unionAll(lines(spark, "color: #abc", file="Z.css")).unionAll(lines(spark, "color: #abd", file="a.css"))
    got = list(text.told(text.colors(commands.colors(src))))
    assert got == [
        "", "=== Hardcoded Colors ===", "Found 5 hardcoded color values in 3 files", "Actionable: 4 | Skipped: 1", "Types: hex(4), rgba(1)", "",
        "FILE: a.css", "  L1:8  #abd  (hex -> #aabbdd)", "    color: #abd", "",
        "FILE: é.css", "  L1:8  #fff  (hex -> #ffffff)", "    color: #fff; fill: #000", "  L1:20  #000  (hex -> #000000)", "    color: #fff; fill: #000", "",
        "FILE: Z.css", "  L1:8  #abc  (hex -> #aabbcc)", "    color: #abc", "",
        "--- Skipped 1 non-actionable colors ---", "  [EFFECT (black/white alpha)] 1 colors in 1 files", "",
    ]
    names = spark.createDataFrame([(n, 1, 1, "v") for n in ("b", "B", "a", "é", "e", "f", "A", "_a")], "file string, line int, col int, value string")
    assert [r.file for r in report.ordered("colors", names).collect()] == ["_a", "a", "A", "b", "B", "e", "é", "f"]


def test_tailwind_texts_and_document(spark):
    """Two arbitrary values, one of them far from the palette: both count as matched, as the summary says."""
    src = lines(spark, "bg-[#ff0000] text-[#00ff00] bg-red-500", file="a.tsx").unionAll(lines(spark, "@theme {", "--a: b;", "--c: d;", "}", "@utility x", file="src/app.css"))
    rows, v4 = commands.tailwind(src, pal(spark, ("--r", "#ff0000"))), commands.tailwind_v4_facts(src, ["src"])
    parts = {r.section: r.value for r in report.tailwind_document(rows, v4).collect()}
    assert '"tailwindVersion":4' in parts["summary"] and '"arbitraryValues":2,"arbitraryWithThemeMatch":2' in parts["summary"]
    assert parts["v4"] == '{"themeVars":2,"utilities":1,"files":["src/app.css"]}'
    got = list(text.told(text.tailwind(rows, v4)))
    assert got == [
        "", "=== Tailwind Color Classes ===", "Found 3 Tailwind color classes in 1 files", "Tailwind v4 detected", "Arbitrary values: 2 (2 match theme vars)", "",
        "--- ARBITRARY VALUES MATCHING THEME (2) ---", "  a.tsx:1:1  bg-[#ff0000] -> EXACT: --r (#ff0000)", "    Use var(--r) or a Tailwind theme color instead of #ff0000",
        "  a.tsx:1:14  text-[#00ff00] -> CLOSE (dE=170.57): --r (#ff0000)", "", "--- Tailwind v4 ---", "  @theme variables: 2", "  @utility definitions: 1", "",
        "FILE: a.tsx", "  L1:1  bg-[#ff0000]  (bg, arbitrary: #ff0000)", "    bg-[#ff0000] text-[#00ff00] bg-red-500", "  L1:14  text-[#00ff00]  (text, arbitrary: #00ff00)", "    bg-[#ff0000] text-[#00ff00] bg-red-500",
        "  L1:29  bg-red-500  (bg, red-500)", "    bg-[#ff0000] text-[#00ff00] bg-red-500", "",
    ]


def test_pattern_texts(spark):
    lists = commands.class_lists(lines(spark, '<p className="p-2 m-1">', "cn('m-1 p-2')", '<i className="a-1 b-2 c-3"><i className="a-1 b-2 c-3">'))
    got = list(text.told(text.patterns(lists)))
    assert got[:15] == [
        "", "=== Repeated Class Patterns ===", "Found 2 repeated patterns across 5 locations", "Criteria: >=2 occurrences, >=2 classes", "",
        '"m-1 p-2"', "   Classes: 2 | Occurrences: 3 | Impact score: 6", "   Sources: className, cn/clsx", "   Consider: CVA variant, @apply directive, or component extraction", "   Locations:",
        "     src/a.tsx:1:4", '       original: "p-2 m-1"', "     src/a.tsx:2:1 [cn/clsx]", "     src/a.tsx:2:1 [cn/clsx]", "",
    ] or got[5] == '"a-1 b-2 c-3"'
    assert got[-4].startswith("TIP: Use class-variance") and '"a-1 b-2 c-3"' in got


FILES = {
    "a.css": b"a {  \r\n  color: #ff0000;\t\r\n}\r\n", "x y+z/b.css": b"\xef\xbb\xbf:root {\n color: #ff0000; /* \xc3\xa9 */  \nlast", "c.css": b"", "d.css": b"\n", "f.css": b"\xef\xbb\xbfx\n",
    "e.css": b"\n".join(b"line %d %s \xc3\xa9%s" % (i, b"#ff0000" if i % 7 == 0 else b"", b" x" * (i % 11)) for i in range(400)), "g.css": b"\xff\xfe x \n\n\n",
}


def test_lossless_lines_and_fixes(spark, tmp_path):
    """Files of many splits: lines are numbered over splits, and all bytes but the replaced values stay."""
    from swatchline.sources.lines import read_raw, read_tree

    for name, data in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        raw = read_raw(spark, [str(tmp_path / "in")])
        assert raw.rdd.getNumPartitions() > 20
        rows = raw.select("file", "line", F.col("raw").cast("binary").alias("raw"), "ending").orderBy("file", "line").collect()
        for name, data in FILES.items():
            mine = [r for r in rows if r.file == str(tmp_path / "in" / name)]
            assert [r.line for r in mine] == list(range(1, len(mine) + 1))
            assert b"".join(bytes(r.raw) + r.ending.encode() for r in mine) == data
        assert [r.line for r in raw.where("file like '%e.css' and raw like 'line 321 %'").collect()] == [322]  # filters don't change numbers
        tree = read_tree(spark, [str(tmp_path / "in")])
        hits = commands.compare(tree, pal(spark, ("--r", "#ff0000")))
        assert commands.write_fixed(tree, hits, str(tmp_path / "out")) == sum(d.count(b"#ff0000") for d in FILES.values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, data in FILES.items():
        out = tmp_path / "out" / str(tmp_path / "in").lstrip("/") / name
        assert out.read_bytes() == data.replace(b"#ff0000", b"var(--r)") if b"#ff0000" in data else not out.exists()


def test_many_matches_in_one_line(spark):
    """16000 colours in one line, with characters of several bytes between them; a line with a zero byte, too."""
    import time

    src = lines(spark, "é #fff; " * 16_000, "a\0 #abc \0 #abd", "#abc#abd")
    began = time.time()
    got = [(r.line, r.value, r.col) for r in extract.color_literals(src).select("line", "value", "col").orderBy("line", "col").collect()]
    assert time.time() - began < 20
    assert got[:16_000] == [(1, "#fff", 9 * i + 4) for i in range(16_000)]
    assert got[16_000:] == [(2, "#abc", 4), (2, "#abd", 11), (3, "#abc", 1), (3, "#abd", 5)]


def test_comments_over_chunks(spark, monkeypatch):
    """Chunks of 7 lines give what one state machine gives, for the scan and for the lines; hits of both kinds of state."""
    import random

    monkeypatch.setattr(context, "CHUNK", 7)
    random.seed(4)
    texts = ["".join(random.choice(["/*", "*/", " x ", "#fff", " "]) for _ in range(random.choice((0, 0, 1, 3)))) for _ in range(300)]
    inside, want = False, []
    for t in texts:
        before = inside
        opens, closes = "/*" in t and "*/" not in t[t.find("/*") + 2 :], "*/" in t
        inside = (not inside) if opens and closes else True if opens else False if closes else inside
        want.append(before or inside)
    src = lines(spark, *texts)
    assert [r.in_block for r in context.block_comments(src).orderBy("line").collect()] == want
    got = {(r.line, r.in_block) for r in context.scanned(src, commands.LITERALS).collect()}
    assert got == {(i, w) for i, (t, w) in enumerate(zip(texts, want, strict=True), 1) if "#fff" in t}


def test_one_scan_for_colours(spark):
    src = spark.read.schema("file string, line int, text string").json(spark.sparkContext.parallelize(['{"file":"a.css","line":1,"text":"color: #fff"}']))
    rows = commands.colors(src)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 1


def test_rows_by_file(spark):
    rows = commands.colors(lines(spark, "color: #fff; fill: #000", "fill: #123456").unionAll(lines(spark, "color: #abc", file="b.css")))
    assert [(r.file, [(h.line, h.value) for h in r.hits]) for r in report.by_file(rows).orderBy("file").collect()] == [("b.css", [(1, "#abc")]), ("src/a.tsx", [(1, "#fff"), (1, "#000"), (2, "#123456")])]


def test_grid_gives_what_the_fold_gives(spark):
    """Random palettes, ties by order and colours outside of the gamut; the plain fold takes the first of the closest."""
    import random

    random.seed(2)
    code = lambda: f"#{random.randrange(1 << 24):06x}"
    palette_ = pal(spark, *((f"--{i}", code()) for i in range(600)), *((f"--d{i}", "#ff0000") for i in range(3)), ("--none", "oklch(1 1 1)"))
    cols = spark.createDataFrame([(code(),) for _ in range(150)] + [("#ff0000",), ("rgb(999,0,0)",), ("x",)], "v string").withColumn("lab", color.to_lab(color.parse_color(F.col("v"))))
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("hex"))
    step = lambda acc, x: color.let(color.distance(F.col("lab"), x["lab"]), lambda d: F.when(d < acc["d"], F.struct(d.alias("d"), x["name"].alias("name"), x["hex"].alias("hex"))).otherwise(acc))
    keys = cols.select("lab").where("lab is not null").distinct()
    told = lambda rows: {r.v: (r.near_name, r.near_hex, r.near_distance) for r in rows.collect()}
    got = told(match.nearest(cols, palette_))
    assert got == told(match._folded(cols, keys, palette_, start, step, ["lab"]))
    assert got["#ff0000"] == ("--d0", "#ff0000", 0.0) and got["x"] == (None, None, None)
    assert told(match.nearest(cols, palette_.where("false")))["#ff0000"] == (None, None, None)
