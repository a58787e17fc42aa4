"""Colour functions as columns: parsing, CIELAB, distance, alpha, names. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swatchline import dims

RGB = "struct<r:double,g:double,b:double>"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: nested expressions stay small however often f uses x."""
    return F.element_at(F.transform(F.array(x), f), 1)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("double")


def _triple(r: Column, g: Column, b: Column) -> Column:
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.struct(r.alias("r"), g.alias("g"), b.alias("b")))


def _number(c: Column) -> Column:
    """The number that a run of digits and points begins with; null if none."""
    return F.regexp_extract(c, r"^(\d*\.?\d*)", 1).try_cast("double")


def named_color(name: Column) -> Column:
    """The code of a colour's name in lower case; null if it's none."""
    told = ",".join(f"{k}:{v}" for k, v in dims.NAMED_COLORS.items())
    return F.element_at(F.expr(f"str_to_map('{told}')"), name)  # one constant, rather than one for each name


def normal(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, dims.TRIM, ""))


def color_type(value: Column) -> Column:
    v = normal(value)
    out = F.when(v.startswith("#"), "hex")
    for name in ("rgba", "rgb", "hsla", "hsl", *dims.FUNCTIONS, "color"):
        out = out.when(v.startswith(name + ("(" if name == "color" else "")), "color()" if name == "color" else name)
    return out.when(named_color(v).isNotNull(), "named").otherwise("unknown")


def parse_hex(value: Column) -> Column:
    def full(digits: Column) -> Column:
        one = lambda i: F.substring(digits, i, 1)
        return F.when(F.length(digits).isin(3, 4), F.concat(one(1), one(1), one(2), one(2), one(3), one(3))).otherwise(digits)

    def parts(digits: Column) -> Column:
        part = lambda i: F.conv(F.nullif(F.regexp_extract(F.substring(digits, i, 2), "^([0-9a-fA-F]+)", 1), F.lit("")), 16, 10).cast("double")
        return let(F.array(part(1), part(3), part(5)), lambda a: _triple(a[0], a[1], a[2]))

    return let(let(F.regexp_replace(value, "#", ""), full), parts)


def _components(value: Column, modern: str, legacy: str, i: int) -> Column:
    return F.when(value.rlike(modern), F.regexp_extract(value, modern, i)).when(value.rlike(legacy), F.regexp_extract(value, legacy, i))


def parse_rgb(value: Column) -> Column:
    scale = F.when(value.rlike(dims.RGB_PERCENT), 2.55).otherwise(1.0)
    return let(F.array(*(round_half_up(_number(_components(value, dims.RGB_MODERN, dims.RGB_LEGACY, i)) * scale) for i in (1, 2, 3))), lambda a: _triple(a[0], a[1], a[2]))


def _hsl_channel(c: Column, turn: Column) -> Column:
    def at(t: Column) -> Column:
        slope = (c["q"] - c["p"]) * 6
        return F.when(t < 1 / 6, c["p"] + slope * t).when(t < 1 / 2, c["q"]).when(t < 2 / 3, c["p"] + slope * (2 / 3 - t)).otherwise(c["p"])

    return let(F.when(turn < 0, turn + 1).when(turn > 1, turn - 1).otherwise(turn), at)


def parse_hsl(value: Column) -> Column:
    h, s, x = (_number(_components(value, dims.HSL_MODERN, dims.HSL_LEGACY, i)) / d for i, d in ((1, 360), (2, 100), (3, 100)))

    def with_bounds(c: Column) -> Column:
        q = F.when(c["x"] < 0.5, c["x"] * (1 + c["s"])).otherwise(c["x"] + c["s"] - c["x"] * c["s"])
        return let(q, lambda q: F.struct(c["h"].alias("h"), c["s"].alias("s"), c["x"].alias("x"), q.alias("q"), (2 * c["x"] - q).alias("p")))

    def channels(c: Column) -> Column:
        each = lambda d: round_half_up(F.when(c["s"] == 0, c["x"]).otherwise(_hsl_channel(c, c["h"] + d)) * 255)
        return let(F.array(each(1 / 3), each(0.0), each(-1 / 3)), lambda a: _triple(a[0], a[1], a[2]))

    return let(let(F.struct(h.alias("h"), s.alias("s"), x.alias("x")), with_bounds), channels)


def parse_color(value: Column) -> Column:
    """Red, green and blue as written, not clamped; null for what can't be parsed."""
    code = lambda v: F.coalesce(named_color(v), F.when(v.startswith("#"), v))
    each = lambda v: F.when(v.startswith("rgb"), parse_rgb(v)).when(v.startswith("hsl"), parse_hsl(v)).otherwise(let(code(v), lambda c: F.when(c.isNotNull(), parse_hex(c))))
    return let(normal(value), each)


def to_hex(rgb: Column) -> Column:
    byte = lambda c: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("long"))), 2, "0")
    return let(rgb, lambda x: F.when(x.isNotNull(), F.concat(F.lit("#"), byte(x["r"]), byte(x["g"]), byte(x["b"]))))


def to_lab(rgb: Column) -> Column:
    def linear(c: Column) -> Column:
        return let(c / 255, lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92))

    def warp(t: Column) -> Column:
        return let(t, lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116))

    def warped(c: Column) -> Column:
        r, g, b = c[0], c[1], c[2]
        x = (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047
        y = r * 0.2126729 + g * 0.7151522 + b * 0.072175
        z = (r * 0.0193339 + g * 0.119192 + b * 0.9503041) / 1.08883
        return F.array(warp(x), warp(y), warp(z))

    def lab(w: Column) -> Column:
        return F.struct((116 * w[1] - 16).alias("l"), (500 * (w[0] - w[1])).alias("a"), (200 * (w[1] - w[2])).alias("b"))

    lines = lambda x: F.array(linear(x["r"]), linear(x["g"]), linear(x["b"]))
    return let(rgb, lambda x: F.when(x.isNotNull(), let(let(lines(x), warped), lab)))


def distance(p: Column, q: Column) -> Column:
    """CIE76 of two LAB structs; infinite if either is null."""
    d = F.sqrt(F.pow(q["l"] - p["l"], F.lit(2)) + F.pow(q["a"] - p["a"], F.lit(2)) + F.pow(q["b"] - p["b"], F.lit(2)))
    return F.coalesce(d, F.lit(float("inf")))


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def alpha(value: Column) -> Column:
    v = normal(value)
    digits = F.substring(v, 2, 100)
    code = F.when(F.length(digits) == 8, F.substring(digits, 7, 2)).when(F.length(digits) == 4, F.concat(F.substring(digits, 4, 1), F.substring(digits, 4, 1)))
    of_hex = round2(F.conv(code, 16, 10).cast("double") / 255)
    modern, percent = _number(F.regexp_extract(v, dims.ALPHA_MODERN, 1)), F.regexp_extract(v, dims.ALPHA_MODERN, 2)
    of_function = F.when(v.rlike(dims.ALPHA_MODERN), F.when(percent == "%", modern / 100).otherwise(modern)).when(
        (v.startswith("rgba") | v.startswith("hsla")) & v.rlike(dims.ALPHA_LEGACY), _number(F.regexp_extract(v, dims.ALPHA_LEGACY, 1))
    )
    return F.when(v.startswith("#"), F.when(of_hex < 1, of_hex)).when(v.startswith("rgb") | v.startswith("hsl"), of_function)


def color_mix(name: Column, a: Column) -> Column:
    return F.concat(F.lit("color-mix(in srgb, var("), name, F.lit(") "), F.floor(a * 100 + 0.5).cast("string"), F.lit("%, transparent)"))


def hue_name(rgb: Column) -> Column:
    def degrees(x: Column) -> Column:
        r, g, b = (x[c] for c in "rgb")
        top, low = F.greatest(r, g, b), F.least(r, g, b)
        h = F.when(top == r, ((g - b) / (top - low)) % 6).when(top == g, (b - r) / (top - low) + 2).otherwise((r - g) / (top - low) + 4)
        return F.floor(h * 60 + 0.5)

    def named(h: Column) -> Column:
        out = F.when((h < 15) | (h >= 345), "red")
        for below, name in ((45, "orange"), (70, "yellow"), (150, "green"), (190, "teal"), (250, "blue"), (290, "purple")):
            out = out.when(h < below, name)
        return out.otherwise("pink")

    def each(x: Column) -> Column:
        r, g, b = (x[c] for c in "rgb")
        grey = (F.abs(r - g) < 15) & (F.abs(g - b) < 15) & (F.abs(r - b) < 15)
        turned = let(degrees(x), lambda h: F.when(h < 0, h + 360).otherwise(h))
        return F.when(grey, F.when(r < 30, "black").when(r > 225, "white").otherwise("gray")).otherwise(let(turned, named))

    return let(rgb, each)


def suggest_name(rgb: Column, lab: Column, prop: Column) -> Column:
    light = let(lab["l"], lambda x: F.when(x < 20, "-dark").when(x < 40, "-700").when(x < 60, "-500").when(x < 80, "-300").otherwise("-light"))
    p = F.lower(F.coalesce(prop, F.lit("")))
    prefix = F.when(p.contains("background") | (p == "bg"), "bg").when(p.contains("border"), "border").when(p.contains("text") | (p == "color"), "text")
    prefix = prefix.when(p.contains("shadow"), "shadow").when(p.contains("outline"), "outline").otherwise("color")
    return F.when(rgb.isNull(), "--color-custom").otherwise(F.concat(F.lit("--"), prefix, F.lit("-"), hue_name(rgb), light))
