"""The catalogue's queries as SQL for DuckDB, built from common table expressions."""

from __future__ import annotations

from swatchline import dims
from swatchline.sources.lines import FILES, TEMPLATES

#: Folders of the projected tree that are searched for a theme, each as a path of its own.
ROOTS = [f"src/app{u}" for u in range(6, 100, 10)]
#: Properties that scalar queries are tried with.
PROPERTIES = ["background-color", "color", "border-color", "box-shadow", "outline", "fill", "width"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(p)})" for p in patterns) + ")"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _first(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {_q(pattern)}, {group}), '')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_q(dims.TRIM)}, '', 'g')"


def _hits(source: str, pattern: str, name: str = "value") -> str:
    """Matches of a pattern in the lines of a source, with byte columns."""
    return (
        f"SELECT * EXCLUDE (m, p, i), m[i] {name}, (strlen(coalesce(array_to_string(p[1:i], ''), '')) + strlen(coalesce(array_to_string(m[1:i - 1], ''), '')) + 1)::INTEGER col FROM ("
        f"SELECT *, unnest(range(1, len(m) + 1)) i FROM (SELECT *, regexp_extract_all(text, {_q(pattern)}) m, string_split_regex(text, {_q(pattern)}) p FROM {source}))"
    )


def _number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '^(\\d*\\.?\\d*)', 1), '') AS DOUBLE)"


def _component(modern: str, legacy: str, i: int) -> str:
    return _number(f"CASE WHEN {_has('v', modern)} THEN regexp_extract(v, {_q(modern)}, {i}) WHEN {_has('v', legacy)} THEN regexp_extract(v, {_q(legacy)}, {i}) END")


def _parsed(name: str, source: str, value: str = "value") -> list[str]:
    """CTEs that end in `name`: the source with v, r, g, b, hex, ll, la, lb."""
    byte = lambda i: f"try_cast('0x' || nullif(regexp_extract(substr(hd, {i}, 2), '^([0-9a-f]+)', 1), '') AS INTEGER)::DOUBLE"
    turn = lambda d: f"(h + {d} - CASE WHEN h + {d} > 1 THEN 1 ELSE 0 END + CASE WHEN h + {d} < 0 THEN 1 ELSE 0 END)"
    channel = lambda d: f"floor(255 * CASE WHEN s = 0 THEN x WHEN {turn(d)} < 1.0::DOUBLE / 6 THEN pp + (qq - pp) * 6 * {turn(d)} WHEN {turn(d)} < 0.5 THEN qq WHEN {turn(d)} < 2.0::DOUBLE / 3 THEN pp + (qq - pp) * 6 * (2.0::DOUBLE / 3 - {turn(d)}) ELSE pp END + 0.5)"
    third = "(1.0::DOUBLE / 3)"
    lin = lambda c: f"CASE WHEN {c} / 255 > 0.04045 THEN pow(({c} / 255 + 0.055) / 1.055, 2.4) ELSE {c} / 255 / 12.92 END"
    warp = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END"
    hexed = lambda c: f"printf('%02x', greatest(0, least(255, floor({c} + 0.5)))::BIGINT)"
    rgb = lambda i: f"CASE WHEN v LIKE 'rgb%' THEN floor({_component(dims.RGB_MODERN, dims.RGB_LEGACY, i)} * CASE WHEN {_has('v', dims.RGB_PERCENT)} THEN 2.55::DOUBLE ELSE 1 END + 0.5) END"
    hsl = lambda i, d: f"CASE WHEN v LIKE 'hsl%' THEN {_component(dims.HSL_MODERN, dims.HSL_LEGACY, i)} / {d} END"
    return [
        f"{name}_1 AS (SELECT s.*, lower({_trim(f"s.{value}")}) v, nc.hex nh FROM {source} s LEFT JOIN named nc ON nc.name = lower({_trim(f"s.{value}")}))",
        f"{name}_2 AS (SELECT *, replace(coalesce(nh, CASE WHEN v LIKE '#%' THEN v END), '#', '') h0, {', '.join(f'{rgb(i)} c{i}' for i in (1, 2, 3))}, {hsl(1, 360)} h, {hsl(2, 100)} s, {hsl(3, 100)} x FROM {name}_1)",
        f"{name}_3 AS (SELECT *, CASE WHEN length(h0) IN (3, 4) THEN h0[1] || h0[1] || h0[2] || h0[2] || h0[3] || h0[3] ELSE h0 END hd, CASE WHEN x < 0.5 THEN x * (1 + s) ELSE x + s - x * s END qq FROM {name}_2)",
        f"{name}_4 AS (SELECT *, 2 * x - qq pp FROM {name}_3)",
        f"{name}_5 AS (SELECT *, coalesce({byte(1)}, c1, {channel('+ ' + third)}) r0, coalesce({byte(3)}, c2, {channel('+ 0')}) g0, coalesce({byte(5)}, c3, {channel('- ' + third)}) b0 FROM {name}_4)".replace("+ + ", "+ ").replace("+ - ", "- "),
        f"{name}_6 AS (SELECT * EXCLUDE (nh, h0, c1, c2, c3, h, s, x, hd, qq, pp, r0, g0, b0), CASE WHEN r0 + g0 + b0 IS NOT NULL THEN r0 END r, CASE WHEN r0 + g0 + b0 IS NOT NULL THEN g0 END g, CASE WHEN r0 + g0 + b0 IS NOT NULL THEN b0 END b FROM {name}_5)",
        f"{name}_7 AS (SELECT *, {lin('r')} lr, {lin('g')} lg, {lin('b')} lc FROM {name}_6)",
        f"{name}_8 AS (SELECT *, (lr * 0.4124564 + lg * 0.3575761 + lc * 0.1804375) / 0.95047 x0, lr * 0.2126729 + lg * 0.7151522 + lc * 0.072175 y0, (lr * 0.0193339 + lg * 0.119192 + lc * 0.9503041) / 1.08883 z0 FROM {name}_7)",
        f"{name}_9 AS (SELECT *, {warp('x0')} fx, {warp('y0')} fy, {warp('z0')} fz FROM {name}_8)",
        f"{name} AS (SELECT * EXCLUDE (lr, lg, lc, x0, y0, z0, fx, fy, fz), CASE WHEN r IS NOT NULL THEN '#' || {hexed('r')} || {hexed('g')} || {hexed('b')} END hex, 116 * fy - 16 ll, 500 * (fx - fy) la, 200 * (fy - fz) lb FROM {name}_9)",
    ]


def _category(prop: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({prop}), {_q(x.lower())})" for x in listed) + f" THEN {_q(c)}" for c, listed in dims.PROPERTY_CATEGORIES.items()) + " END"


def _fold(rows: str, keys: str, meant: bool) -> str:
    """Rows with near_name, near_hex, near_distance by an ordered fold over the palette."""
    d = "sqrt(pow(e.ll - k.ll, 2) + pow(e.la - k.la, 2) + pow(e.lb - k.lb, 2))"
    fits = "CASE " + " ".join(f"WHEN k.cat = {_q(c)} AND regexp_matches(e.name, {_q('(?i)' + p)}) THEN 1" for c, p in dims.CATEGORY_NAMES.items()) + " ELSE 0 END" if meant else "0"
    better = "x.d < a.d - 0.5 OR (abs(x.d - a.d) <= 0.5 AND x.s > a.s)" if meant else "x.d < a.d"
    by = [k.strip() for k in keys.split(",")]
    cols = ", ".join(f"k.{c}" for c in by)
    on = " AND ".join(f"w.{c} IS NOT DISTINCT FROM f.{c}" for c in by)
    start = "{'d': 'Infinity'::DOUBLE, 's': 0, 'name': NULL::VARCHAR, 'hex': NULL::VARCHAR}"
    item = f"{{'d': {d}, 's': {fits}, 'name': e.name, 'hex': e.hex}}"
    return (
        f"SELECT w.*, f.near.name near_name, f.near.hex near_hex, CASE WHEN f.near.name IS NOT NULL THEN floor(f.near.d * 100 + 0.5) / 100 END near_distance FROM {rows} w LEFT JOIN ("
        f"SELECT {cols}, list_reduce(list_prepend({start}, list({item} ORDER BY e.ord)), lambda a, x: CASE WHEN {better} THEN x ELSE a END) near FROM (SELECT DISTINCT {keys} FROM {rows} WHERE ll IS NOT NULL) k, pal e WHERE e.ll IS NOT NULL GROUP BY {cols}) f ON {on}"
    )


def _hue() -> str:
    top = "greatest(r, g, b)"
    gap = f"({top} - least(r, g, b))"
    h = f"floor(60 * CASE WHEN {top} = r THEN fmod((g - b) / {gap}, 6) WHEN {top} = g THEN (b - r) / {gap} + 2 ELSE (r - g) / {gap} + 4 END + 0.5)"
    turned = f"({h} + CASE WHEN {h} < 0 THEN 360 ELSE 0 END)"
    cuts = "".join(f" WHEN {turned} < {below} THEN {_q(n)}" for below, n in ((15, "red"), (45, "orange"), (70, "yellow"), (150, "green"), (190, "teal"), (250, "blue"), (290, "purple"), (345, "pink")))
    return f"CASE WHEN abs(r - g) < 15 AND abs(g - b) < 15 AND abs(r - b) < 15 THEN CASE WHEN r < 30 THEN 'black' WHEN r > 225 THEN 'white' ELSE 'gray' END{cuts} ELSE 'red' END"


def _suggest(prop: str) -> str:
    p = f"lower(coalesce({prop}, ''))"
    prefix = f"CASE WHEN contains({p}, 'background') OR {p} = 'bg' THEN 'bg' WHEN contains({p}, 'border') THEN 'border' WHEN contains({p}, 'text') OR {p} = 'color' THEN 'text' WHEN contains({p}, 'shadow') THEN 'shadow' WHEN contains({p}, 'outline') THEN 'outline' ELSE 'color' END"
    light = "CASE WHEN ll < 20 THEN '-dark' WHEN ll < 40 THEN '-700' WHEN ll < 60 THEN '-500' WHEN ll < 80 THEN '-300' ELSE '-light' END"
    return f"CASE WHEN r IS NULL THEN '--color-custom' ELSE '--' || {prefix} || '-' || {_hue()} || {light} END"


_ALPHA = (
    "CASE WHEN v LIKE '#%' THEN CASE WHEN floor(ah / 255.0 * 100 + 0.5) / 100 < 1 THEN floor(ah / 255.0 * 100 + 0.5) / 100 END "
    f"WHEN (v LIKE 'rgb%' OR v LIKE 'hsl%') AND {_has('v', dims.ALPHA_MODERN)} THEN {_number(f'regexp_extract(v, {_q(dims.ALPHA_MODERN)}, 1)')} / CASE WHEN regexp_extract(v, {_q(dims.ALPHA_MODERN)}, 2) = '%' THEN 100 ELSE 1 END "
    f"WHEN (v LIKE 'rgba%' OR v LIKE 'hsla%') AND {_has('v', dims.ALPHA_LEGACY)} THEN {_number(f'regexp_extract(v, {_q(dims.ALPHA_LEGACY)}, 1)')} END"
)


def _with_alpha(source: str) -> str:
    digits = "substr(v, 2)"
    code = f"CASE WHEN length({digits}) = 8 THEN substr({digits}, 7, 2) WHEN length({digits}) = 4 THEN {digits}[4] || {digits}[4] END"
    return f"SELECT *, {_ALPHA} alpha FROM (SELECT *, CASE WHEN v LIKE '#%' THEN try_cast('0x' || {code} AS INTEGER)::DOUBLE END ah FROM {source})"


def _type(value: str) -> str:
    v = f"lower({_trim(value)})"
    tests = [("#", "hex"), *((n, n) for n in ("rgba", "rgb", "hsla", "hsl", *dims.FUNCTIONS)), ("color(", "color()")]
    return "CASE " + " ".join(f"WHEN starts_with({v}, {_q(p)}) THEN {_q(n)}" for p, n in tests) + f" WHEN {v} IN (SELECT name FROM named) THEN 'named' ELSE 'unknown' END"


def _context(value: str) -> str:
    t, has = _trim("text"), lambda p: _has(_trim("text"), p)
    return (
        f"CASE WHEN {has(dims.DEFINES)} THEN 'css-definition' WHEN is_canvas OR (has_usage AND NOT is_style) THEN 'canvas' WHEN is_builder THEN 'theme-definition' "
        f"WHEN is_definition THEN CASE WHEN contains({t}, 'var(--') THEN 'actionable' ELSE 'theme-definition' END WHEN is_mapping THEN 'mapping' "
        f"WHEN {has(dims.META_VALUE)} AND {has(dims.META_TAG)} THEN 'meta' WHEN {has(dims.TEMPLATE_OPEN)} AND {has(dims.TEMPLATE_VALUE)} THEN 'generated' "
        f"WHEN {has(dims.KEY_CSS)} AND {_has(f'string_split({t}, {_q(chr(58))})[-1]', dims.KEY_SUFFIX)} THEN 'mapping' WHEN {has(dims.KEY_HEX)} OR {has(dims.KEY_STRING)} THEN 'mapping' "
        f"WHEN {has(dims.BRIDGE)} OR {has(dims.FALLBACK)} THEN 'canvas' WHEN {_any(f'lower({value})', dims.EFFECTS)} THEN 'effect' WHEN {_has(value, dims.EFFECT_HEX)} AND {has(dims.EFFECT_LINE)} THEN 'effect' ELSE 'actionable' END"
    )


def _ctes() -> dict[str, str]:
    """CTEs by name, each after those it reads."""
    h = "((event_id * 7919 + user_id * 104729) % 16777216)"
    p = "(((event_id % 39 + 1) * 424243) % 16777216)"
    near = f"({p} - {p} % 256 + ({p} % 256 + 3) % 256)"
    k = f"((event_id + user_id) % {len(TEMPLATES)})"
    text = f"CASE WHEN {k} IN (46, 47) AND user_id % 7 <> 0 THEN 'plain' ELSE {_list(TEMPLATES)}[{k} + 1] END"
    for mark, c in (("{H}", h), ("{P}", p), ("{N}", near)):
        text = f"replace({text}, {_q(mark)}, printf('%06x', {c}))"
    libraries = r"(?i)(?:from|require)\s*\(?\s*['\"](?:".replace('\\"', '"') + "|".join(x.replace(".", r"\.") for x in dims.CANVAS_IMPORTS) + ")"
    ext = "lower(regexp_extract(file, '\\.([^./]*)$', 1))"
    script = f"{ext} IN ({', '.join(_q(x) for x in dims.SCRIPT_EXTENSIONS)})"
    names = ", ".join(f"({_q(n)}, {_q(x)})" for n, x in dims.NAMED_COLORS.items())
    opens, closes = "(contains(text, '/*') AND NOT contains(substr(text, strpos(text, '/*') + 2), '*/'))", "contains(text, '*/')"
    word = f"lower(regexp_extract(match, {_q(dims.NAMED_WORD)}, 1))"
    part = lambda pattern, i: _first("value", pattern, i)
    arb, std, spec = (_has("value", x) for x in (dims.TW_ARBITRARY, dims.TW_STANDARD, dims.TW_SPECIAL))
    spec = f"({spec} AND regexp_extract(value, {_q(dims.TW_SPECIAL)}, 2) IN ({', '.join(_q(x) for x in dims.TW_SPECIALS)}))"
    entry = f"file IN ({', '.join(_q(f'{r}/{n}') for r in ROOTS for n in dims.TW_ENTRY_FILES)})"
    plain = f"NOT {_has('text', dims.COMMENT_LINE)} AND NOT in_block AND NOT contains(value, '${{') AND type <> 'unknown'"
    out: list[str] = [
        f"src AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id)::INTEGER line, text FROM (SELECT event_id, replace({_list(FILES)}[user_id % {len(FILES)} + 1], '{{u}}', user_id::VARCHAR) file, {text} text FROM events))",
        f"named AS (SELECT * FROM (VALUES {names}) t(name, hex))",
        "pal0 AS (SELECT p_partkey::INTEGER ord, '--' || ['color', 'bg', 'text', 'border'][p_partkey % 4 + 1] || '-' || p_partkey AS name, '#' || printf('%06x', (p_partkey * 424243) % 16777216) AS hx FROM part WHERE p_partkey BETWEEN 1 AND 39)",
        *_parsed("pal", "pal0", "hx"),
        f"hits AS ({_hits('src', dims.COLOR)})",
        "vals AS (SELECT DISTINCT value FROM hits)",
        *_parsed("pv", "vals"),
        f"pva AS ({_with_alpha('pv')})",
        f"f1 AS (SELECT *, CASE WHEN {opens} AND NOT {closes} THEN 1 WHEN {closes} AND NOT {opens} THEN 0 END force, ({opens} AND {closes})::INTEGER flip FROM src)",
        "f2 AS (SELECT *, count(force) OVER (PARTITION BY file ORDER BY line) run FROM f1)",
        "f3 AS (SELECT *, (coalesce(max(force) OVER (PARTITION BY file, run), 0) + sum(flip) OVER (PARTITION BY file, run ORDER BY line)) % 2 AS st FROM f2)",
        "blocks AS (SELECT file, line, text, st = 1 OR coalesce(lag(st) OVER (PARTITION BY file ORDER BY line), 0) = 1 AS in_block FROM f3)",
        f"info AS (SELECT file, {script} AND bool_or(line <= {dims.IMPORT_LINES} AND ({_has('text', libraries)} OR {_has('text', dims.OG_IMAGE)})) is_canvas, {_any('file', dims.DEFINITION_FILES)} is_definition, {_any('file', dims.MAPPING_FILES)} is_mapping, "
        f"{script} AND bool_or({_any('text', dims.THEME_BUILDERS)}) is_builder, {script} AND bool_or(contains(text, 'getCssVar') OR contains(text, 'getComputedStyle')) has_usage, {ext} IN ({', '.join(_q(x) for x in dims.STYLE_EXTENSIONS)}) is_style FROM src GROUP BY file)",
        f"ph AS (SELECT * FROM (SELECT *, {_type('value')} AS type FROM ({_hits('blocks', dims.COLOR)})) WHERE {plain})",
        f"nc AS (SELECT *, {word} AS value FROM ({_hits('src', dims.NAMED_CSS, 'match')}) WHERE {word} IN (SELECT name FROM named))",
        f"nj AS (SELECT *, {word} AS value FROM ({_hits('src', dims.NAMED_JS, 'match')}) WHERE {word} IN (SELECT name FROM named))",
        f"co0 AS (SELECT file, line, text, value, col, type, value AS match, 0 AS rk FROM ph WHERE NOT ({_has('text', dims.TYPE_ANNOTATION)} AND NOT regexp_matches(text, '[''\"]')) "
        + "".join(f"UNION ALL SELECT file, line, text, value, col, 'named', match, {rk} FROM {n} WHERE NOT {_has('text', dims.COMMENT_LINE)} " for rk, n in ((1, "nc"), (2, "nj"))) + ")",
        "co1 AS (SELECT * FROM co0 QUALIFY row_number() OVER (PARTITION BY file, line, col ORDER BY rk, value) = 1)",
        *_parsed("co2", "co1"),
        f"colors AS (SELECT file, line, col, value, type, hex, text, context, CASE context {' '.join(f'WHEN {_q(a)} THEN {_q(b)}' for a, b in dims.CONTEXT_LABELS.items())} END AS label, context = 'actionable' AS actionable FROM (SELECT c.*, {_context('match')} context FROM co2 c JOIN info USING (file)))",
        "ph1 AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY file, line, col ORDER BY value) = 1)",
        *_parsed("cm0", "ph1"),
        f"cm1 AS (SELECT *, {_category('prop')} cat FROM (SELECT *, coalesce({_first('text', dims.CSS_PROPERTY)}, {_first('text', dims.JS_PROPERTY)}) prop FROM ({_with_alpha('cm0')})))",
        f"cm2 AS ({_fold('cm1', 'll, la, lb, cat', True)})",
        f"cm3 AS (SELECT c.*, CASE WHEN near_distance = 0 THEN 'exact' WHEN near_distance <= 10 THEN 'close' ELSE 'unmatched' END status, {_context('value')} context FROM cm2 c JOIN info USING (file))",
        "cmp AS (SELECT file, line, col, value, type, hex, text, context, context = 'actionable' AS actionable, prop, status, near_name, near_hex, near_distance, "
        "CASE WHEN context = 'actionable' AND status <> 'unmatched' THEN CASE WHEN alpha < 1 THEN 'color-mix(in srgb, var(' || near_name || ') ' || floor(alpha * 100 + 0.5)::BIGINT || '%, transparent)' ELSE 'var(' || near_name || ')' END END suggestion, "
        f"CASE WHEN context = 'actionable' AND status = 'unmatched' THEN {_suggest('prop')} END name_suggestion FROM cm3)",
        f"tw AS (SELECT file, line, col, value, text, CASE WHEN {arb} THEN {part(dims.TW_ARBITRARY, 1)} WHEN {std} THEN {part(dims.TW_STANDARD, 1)} ELSE {part(dims.TW_SPECIAL, 1)} END prefix, "
        f"CASE WHEN {arb} THEN NULL WHEN {std} THEN {part(dims.TW_STANDARD, 2)} ELSE {part(dims.TW_SPECIAL, 2)} END color, CASE WHEN NOT {arb} AND {std} THEN {part(dims.TW_STANDARD, 3)} END shade, "
        f"CASE WHEN {arb} THEN NULL WHEN {std} THEN {part(dims.TW_STANDARD, 4)} ELSE {part(dims.TW_SPECIAL, 3)} END opacity, CASE WHEN {arb} THEN {part(dims.TW_ARBITRARY, 2)} END arbitrary FROM ({_hits('src', dims.TAILWIND)}) WHERE {arb} OR {std} OR {spec})",
        f"tw0 AS (SELECT DISTINCT * EXCLUDE (text), {_trim('text')} AS context, arbitrary AS av FROM tw WHERE NOT {_has('text', dims.COMMENT_LINE)})",
        *_parsed("tw1", "tw0", "av"),
        f"tw2 AS ({_fold('tw1', 'll, la, lb', False)})",
        "twa AS (SELECT file, line, col, value, prefix, color, shade, opacity, arbitrary, context, near_name, near_hex, near_distance, CASE WHEN near_distance = 0 THEN 'exact' WHEN near_distance <= 10 THEN 'close' END arbitrary_status FROM tw2)",
        "tailwind AS (SELECT *, CASE arbitrary_status WHEN 'exact' THEN 'Use var(' || near_name || ') or a Tailwind theme color instead of ' || arbitrary WHEN 'close' THEN 'Close to ' || near_name || ' (' || near_hex || ', dE=' || regexp_replace(near_distance::VARCHAR, '\\.0$', '') || ')' END suggestion FROM twa)",
        "cls AS (SELECT file, line, text, col, " + _trim(f"regexp_extract(match, {_q(dims.CLASS_VALUE)}, 1)") + " classes, 'className' AS source FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_hits('src', x, 'match')})" for x in dims.CLASS_ATTRIBUTES) + f") WHERE NOT {_has('text', dims.COMMENT_LINE_JSX)} AND {_trim(f"regexp_extract(match, {_q(dims.CLASS_VALUE)}, 1)")} <> '')",
        f"cf0 AS (SELECT file, line, text, col, {_trim('x')} classes, 'cn/clsx' AS source FROM (SELECT *, unnest(regexp_extract_all(match, {_q(dims.CLASS_ARGUMENT)}, 1)) x FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_hits('src', x, 'match')})" for x in dims.CLASS_FUNCTIONS) + f") WHERE NOT {_has('text', dims.COMMENT_LINE_JSX)}))",
        "cfn AS (SELECT * FROM cf0 WHERE NOT contains(classes, '${') AND (contains(classes, '-') OR contains(classes, ' ')))",
        f"lists AS (SELECT * FROM (SELECT *, list_filter(string_split_regex(classes, {_q(dims.SPACE + '+')}), lambda x: x <> '') tokens FROM (SELECT file, line, col, text, classes, source FROM cls UNION ALL SELECT file, line, col, text, classes, source FROM cfn)) WHERE len(tokens) >= 2)",
        "apat AS (SELECT array_to_string(list_sort(tokens), ' ') pattern, count(*) n, any_value(len(tokens))::INTEGER class_count FROM lists GROUP BY 1)",
        "pats AS (SELECT *, n * class_count impact FROM apat WHERE n >= 2)",
        "cfreq AS (SELECT unnest(tokens) AS class, count(*) n FROM lists GROUP BY 1)",
        "pt AS (SELECT pattern, n, unnest(string_split(pattern, ' ')) AS class, unnest(range(len(string_split(pattern, ' ')))) i FROM apat)",
        "pt2 AS (SELECT pt.* FROM pt JOIN cfreq c ON c.class = pt.class WHERE c.n >= 2)",
        f"entry AS (SELECT * FROM src WHERE {entry})",
        f"tv AS (SELECT DISTINCT file, regexp_extract(t, {_q(dims.THEME_VAR)}, 1) AS name FROM (SELECT file, unnest(string_split(block, chr(10))) t FROM (SELECT file, unnest(regexp_extract_all(string_agg(text, chr(10) ORDER BY line), {_q(dims.THEME_BLOCK)}, 1)) block FROM entry GROUP BY file)) WHERE regexp_extract(t, {_q(dims.THEME_VAR)}, 1) <> '')",
    ]
    return {x.split(" AS ", 1)[0].strip(): x for x in out}


def oracle_sql() -> dict[str, str]:
    ctes = _ctes()
    place = "file, line, col, value"
    excluded = f"NOT {_has('file', dims.EXCLUDED)}"
    default = "(?i)\\.(" + "|".join(dims.EXTENSIONS) + ")$"
    props = ", ".join(f"({_q(p)})" for p in PROPERTIES)
    css = f"coalesce({_first('text', dims.CSS_PROPERTY)}, {_first('text', dims.JS_PROPERTY)})"
    semantic = f"(SELECT *, {_category('prop')} cat FROM pv, (VALUES {props}) t(prop))"
    plain_tw = "(SELECT DISTINCT file, line, col, value, prefix, color FROM tailwind)"
    by = lambda key, source, other="unknown": f"SELECT coalesce(nullif({key}, ''), '{other}') AS key, count(*) n FROM {source} GROUP BY 1"
    at = "strpos(substr(acc.text, greatest(e.col - 1, 1)), e.value)"
    spot = f"({at} + greatest(e.col - 1, 1) - 1)"
    state = "{'text': %s, 'n': %s, 'col': 0, 'value': '', 'suggestion': ''}"
    fix = f"CASE WHEN {at} > 0 THEN " + state % (f"left(acc.text, {spot} - 1) || e.suggestion || substr(acc.text, {spot} + length(e.value))", "acc.n + 1") + " ELSE acc END"
    sql = {
        "scan_lines": "SELECT file, line, text FROM src",
        "palette": "SELECT ord, name, hex FROM pal",
        "scan_include_glob": f"SELECT file, line, text FROM src WHERE regexp_matches(file, '\\.(css|html)$') AND {excluded}",
        "scan_exclude_glob": f"SELECT file, line, text FROM src WHERE {_has('file', default)} AND {excluded} AND NOT contains(file, '/theme/') AND file NOT LIKE '%.html'",
        "scan_builtin_excludes": f"SELECT file, line, text FROM src WHERE {_has('file', default)} AND {excluded}",
        "color_literals": f"SELECT {place} FROM hits",
        "named_css": f"SELECT {place}, match FROM nc",
        "named_js": f"SELECT {place}, match FROM nj",
        "tailwind_classes": "SELECT * EXCLUDE (text) FROM tw",
        "class_attributes": "SELECT file, line, col, classes FROM cls",
        "class_functions": "SELECT file, line, col, classes FROM cfn",
        "css_property": f"SELECT file, line, {css} prop FROM src",
        "theme_vars": "SELECT file, name FROM tv",
        "utility_count": f"SELECT file, sum(len(regexp_extract_all(text, {_q(dims.UTILITY)})))::BIGINT utilities FROM entry GROUP BY file",
        "tailwind_version": f"SELECT CASE WHEN bool_or({_has('text', dims.THEME_OPEN)}) THEN 4 ELSE 3 END AS version, (SELECT count(*) FROM tv) theme_vars, coalesce(sum(len(regexp_extract_all(text, {_q(dims.UTILITY)}))), 0)::BIGINT utilities, coalesce(string_agg(DISTINCT file, ',' ORDER BY file) FILTER ({_has('text', dims.THEME_OPEN)}), '') files FROM entry",
        "color_type": f"SELECT value, {_type('value')} AS type FROM vals",
        "parse_hex": "SELECT value, r, g, b FROM pv WHERE value LIKE '#%'",
        "parse_rgb": "SELECT value, r, g, b FROM pv WHERE lower(value) LIKE 'rgb%'",
        "parse_hsl": "SELECT value, r, g, b FROM pv WHERE lower(value) LIKE 'hsl%'",
        "normalize_hex": "SELECT value, hex FROM pv",
        "rgb_to_lab": "SELECT value, round(ll, 6) lab_l, round(la, 6) lab_a, round(lb, 6) lab_b FROM pv WHERE r IS NOT NULL",
        "delta_e": "SELECT p.value, e.name, floor(sqrt(pow(e.ll - p.ll, 2) + pow(e.la - p.la, 2) + pow(e.lb - p.lb, 2)) * 100 + 0.5) / 100 distance FROM pv p, pal e WHERE p.r IS NOT NULL",
        "alpha": "SELECT value, alpha FROM pva",
        "color_mix": "SELECT value, 'color-mix(in srgb, var(--x) ' || floor(alpha * 100 + 0.5)::BIGINT || '%, transparent)' mix FROM pva WHERE alpha < 1",
        "hue_name": f"SELECT value, {_hue()} hue FROM pv WHERE r IS NOT NULL",
        "suggest_name": f"SELECT value, prop, {_suggest('prop')} AS name FROM pv, (VALUES {props}) t(prop)",
        "property_category": f"SELECT prop, {_category('prop')} category FROM (SELECT DISTINCT {css} prop FROM src)",
        "comment_lines": f"SELECT file, line, text FROM src WHERE {_has('text', dims.COMMENT_LINE)}",
        "block_comments": "SELECT file, line FROM blocks WHERE in_block",
        "interpolation_filter": "SELECT file, line FROM src WHERE NOT contains(text, '${')",
        "type_annotation_filter": f"SELECT file, line FROM src WHERE {_has('text', dims.TYPE_ANNOTATION)} AND NOT regexp_matches(text, '[''\"]')",
        "file_info": "SELECT * FROM info",
        "context_class": f"SELECT {place}, {_context('value')} context FROM hits JOIN info USING (file)",
        "context_counts": by("context", "colors"),
        "nearest": f"SELECT value, near_name, near_distance FROM ({_fold('pv', 'll, la, lb', False)})",
        "nearest_semantic": f"SELECT value, prop, near_name, near_distance FROM ({_fold(semantic, 'll, la, lb, cat', True)})",
        "colors": "SELECT * FROM colors",
        "colors_types": by("type", "colors"),
        "colors_summary": "SELECT count(*) total, count(DISTINCT file) files, count(*) FILTER (actionable) actionable, count(*) FILTER (NOT actionable) skipped FROM colors",
        "compare": "SELECT * FROM cmp",
        "match_status": "SELECT status, actionable, count(*) n FROM cmp GROUP BY ALL",
        "suggestion": f"SELECT {place}, suggestion FROM cmp WHERE suggestion IS NOT NULL",
        "name_suggestion": f"SELECT {place}, name_suggestion FROM cmp WHERE name_suggestion IS NOT NULL",
        "compare_summary": "SELECT count(*) total, " + ", ".join(f"count(*) FILTER (actionable AND status = '{s}') {s}" for s in ("exact", "close", "unmatched")) + ", count(*) FILTER (NOT actionable) skipped, count(DISTINCT file) files FROM cmp",
        "compare_examples": f"SELECT {place}, context, (row_number() OVER (PARTITION BY context ORDER BY file, line, col))::INTEGER AS rank, count(*) OVER (PARTITION BY context) - 3 AS more FROM cmp WHERE NOT actionable QUALIFY row_number() OVER (PARTITION BY context ORDER BY file, line, col) <= 3",
        "compare_diff": f"SELECT {place}, hex, status FROM cmp c WHERE NOT EXISTS (SELECT 1 FROM cmp o WHERE length(o.file) % 2 = 0 AND o.file = c.file AND o.value = c.value AND o.hex IS NOT DISTINCT FROM c.hex)",
        "baseline": f"SELECT {place}, hex, status, context FROM cmp",
        "fixed_lines": f"SELECT file, line, x.text AS text, x.n AS n_fixed FROM (SELECT c.file, c.line, list_reduce(list_prepend({state % ('any_value(c.text)', '0')}, list({{'text': '', 'n': 0, 'col': c.col, 'value': c.value, 'suggestion': c.suggestion}} ORDER BY c.col DESC)), lambda acc, e: {fix}) x FROM cmp c WHERE actionable AND status = 'exact' AND suggestion IS NOT NULL GROUP BY c.file, c.line) WHERE x.n > 0",
        "tailwind": "SELECT * FROM tailwind",
        "tailwind_summary": "SELECT count(*) total, count(DISTINCT file) files, count(arbitrary) arbitrary, count(*) FILTER (arbitrary IS NOT NULL AND near_name IS NOT NULL) arbitrary_with_match FROM tailwind",
        "tailwind_prefixes": by("prefix", plain_tw),
        "tailwind_colors": by("color", plain_tw, "arbitrary"),
        "arbitrary_match": "SELECT DISTINCT value, near_name, near_distance, arbitrary_status FROM tailwind WHERE arbitrary IS NOT NULL",
        "patterns": "SELECT * FROM pats",
        "class_freq": "SELECT * FROM cfreq",
        "class_pairs": "SELECT a.class || ' ' || b.class pair, sum(a.n)::BIGINT n FROM pt2 a JOIN pt2 b ON a.pattern = b.pattern AND a.i < b.i GROUP BY 1 HAVING sum(a.n) >= 4 ORDER BY n DESC, pair LIMIT 20",
        "subset_relations": "SELECT a.pattern subset, b.pattern superset, a.n subset_count, b.n superset_count, array_to_string(list_sort(a.c), ' ') shared, array_to_string(list_sort(list_filter(b.c, lambda x: NOT list_contains(a.c, x))), ' ') extra FROM (SELECT *, list_distinct(string_split(pattern, ' ')) c FROM pats) a JOIN (SELECT *, list_distinct(string_split(pattern, ' ')) c FROM pats) b ON len(a.c) < len(b.c) AND list_has_all(b.c, a.c) ORDER BY a.impact DESC, a.pattern, b.impact DESC, b.pattern LIMIT 10",
        "patterns_summary": "SELECT count(*) patterns, coalesce(sum(n), 0)::BIGINT locations FROM pats",
    }
    pack = lambda *cols: "to_json({" + ", ".join(f"'{n}': {c}" for n, c in cols) + "})"
    rows = lambda section, names, by, source: f"SELECT {_q(section)} AS section, {by} AS part, {pack(*((n, n) for n in names))}::VARCHAR AS value FROM {source}"
    tally = lambda section, key, source, other="unknown": f"SELECT {_q(section)} AS section, coalesce(nullif({key}, ''), '{other}') AS part, count(*)::VARCHAR AS value FROM {source} GROUP BY 2"
    head = lambda source, *cols: f"SELECT 'summary' AS section, NULL AS part, {pack(*cols)}::VARCHAR AS value FROM {source}"
    hit = ["file", "line", "col", "value", "type", "hex", "text", "context", "label", "actionable"]
    kind = [x for x in hit if x != "label"] + ["prop", "status", "near_name", "near_hex", "near_distance", "suggestion", "name_suggestion"]
    tail = ["file", "line", "col", "value", "prefix", "color", "shade", "opacity", "arbitrary", "context", "near_name", "near_hex", "near_distance", "arbitrary_status", "suggestion"]
    status = lambda s, more="": f"count(*) FILTER (status = '{s}'{more})"
    three = ("exact", "close", "unmatched")
    sql["patterns_locations"] = "SELECT pattern, file, line, col, classes AS original, " + _trim("text") + " AS context, source FROM (SELECT *, array_to_string(list_sort(tokens), ' ') pattern FROM lists) JOIN pats USING (pattern)"
    sql["colors_json"] = " UNION ALL ".join([
        head("colors", ("command", "'colors'"), ("totalColors", "count(*)"), ("actionable", "count(*) FILTER (actionable)"), ("skipped", "count(*) FILTER (NOT actionable)"), ("totalFiles", "count(DISTINCT file)")),
        tally("byType", "type", "colors"), tally("skippedByContext", "context", "colors WHERE NOT actionable"),
        rows("actionable", hit, "file", "colors WHERE actionable"), rows("skipped", hit, "file", "colors WHERE NOT actionable"),
    ])
    sql["compare_json"] = " UNION ALL ".join([
        head("cmp", ("command", "'compare'"), ("threshold", "10.0::DOUBLE"), ("total", "count(*)"), ("actionable", "count(*) FILTER (actionable)"), ("skipped", "count(*) FILTER (NOT actionable)"),
             ("byStatus", "{" + ", ".join(f"'{x}': {status(x)}" for x in three) + "}"), ("actionableByStatus", "{" + ", ".join(f"'{x}': " + status(x, " AND actionable") for x in three) + "}")),
        rows("palette", ["name", "hex"], "name", "pal"), tally("skippedByContext", "context", "cmp WHERE NOT actionable"),
        rows("actionable", kind, "status", "cmp WHERE actionable"), rows("skipped", kind, "context", "cmp WHERE NOT actionable"),
    ])
    sql["tailwind_json"] = " UNION ALL ".join([
        head("tailwind", ("command", "'tailwind'"), ("tailwindVersion", f"(SELECT CASE WHEN bool_or({_has('text', dims.THEME_OPEN)}) THEN 4 ELSE 3 END FROM entry)"), ("totalClasses", "count(*)"), ("totalFiles", "count(DISTINCT file)"), ("arbitraryValues", "count(arbitrary)"), ("arbitraryWithThemeMatch", "count(*) FILTER (arbitrary IS NOT NULL AND near_name IS NOT NULL)")),
        "SELECT 'v4' section, NULL part, '{\"themeVars\":' || (SELECT count(*) FROM tv) || ',\"utilities\":' || coalesce(sum(len(regexp_extract_all(text, " + _q(dims.UTILITY) + "))), 0) || ',\"files\":[' || string_agg(DISTINCT '\"' || file || '\"', ',' ORDER BY '\"' || file || '\"') FILTER (" + _has('text', dims.THEME_OPEN) + ") || ']}' AS value FROM entry HAVING bool_or(" + _has('text', dims.THEME_OPEN) + ")",
        tally("byPrefix", "prefix", "tailwind"), tally("byColor", "color", "tailwind", "arbitrary"), rows("results", tail, "file", "tailwind"),
    ])
    sql["patterns_json"] = " UNION ALL ".join([
        head("pats", ("command", "'patterns'"), ("totalPatterns", "count(*)"), ("minCount", "2"), ("minClasses", "2"), ("totalLocations", "coalesce(sum(n), 0)::BIGINT"), ("subsetRelations", f"(SELECT count(*) FROM ({sql['subset_relations']}))")),
        "SELECT 'patterns' AS section, pattern AS part, " + pack(("normalized", "pattern"), ("classCount", "class_count"), ("occurrences", "n"), ("impactScore", "impact")) + "::VARCHAR AS value FROM pats",
        rows("locations", ["pattern", "file", "line", "col", "original", "context", "source"], "pattern", f"({sql['patterns_locations']})"),
        rows("subsetRelations", ["subset", "superset", "subset_count", "superset_count", "shared", "extra"], "subset", f"({sql['subset_relations']})"),
        rows("frequentSubsets", ["pair", "n"], "pair", f"({sql['class_pairs']})"),
    ])
    page = "cls AS" + ctes["cls"].split("cls AS", 1)[1].replace("FROM src)", "FROM pg)")
    sql = {n: "WITH " + ", ".join(ctes.values()) + " " + x for n, x in sql.items()}
    sql["pages_class_attributes"] = "WITH pg AS (SELECT file, line::INTEGER line, text FROM (SELECT 'page' || page_id AS file, unnest(range(1, len(string_split(html, chr(10))) + 1)) line, unnest(string_split(html, chr(10))) AS text FROM pages)), " + page + " SELECT file, line, col, classes FROM cls"
    return sql
