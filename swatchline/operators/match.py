"""Nearest palette entry of a colour, plain and with regard to the property's meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchline import dims
from swatchline.functions import color

#: A palette is folded as one array per colour; more entries than this are refused rather than collected.
MOST_ENTRIES = 100_000
#: Side of a grid's cell in LAB, and the outermost cells; there are 17^3 cells at most.
SIDE, MOST_CELL = 16.0, 8


def palette_lab(palette: DataFrame) -> DataFrame:
    """(ord, name, hex) with LAB; entries that aren't colours are left out."""
    return palette.withColumn("lab", color.to_lab(color.parse_color(F.col("hex")))).where(F.col("lab").isNotNull())


def palette_array(palette: DataFrame) -> DataFrame:
    """One row: the palette in order, as an array."""
    rows = palette_lab(palette).select("ord", "name", "hex", "lab").limit(MOST_ENTRIES + 1)
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "hex", "lab"))).alias("entries"))
    return one.select(F.when(F.size("entries") <= MOST_ENTRIES, F.col("entries")).otherwise(F.raise_error(F.lit("palette too large"))).alias("entries"))


def category(prop: Column) -> Column:
    """Meaning of a property: the first category with a listed name equal to it or in it."""
    p = F.lower(prop)
    out = F.when(F.lit(False), F.lit(""))
    for name, listed in dims.PROPERTY_CATEGORIES.items():
        out = out.when(reduce(lambda a, b: a | b, (p.contains(x.lower()) for x in listed)), name)
    return out


def _meant(name: Column, cat: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for c, pattern in dims.CATEGORY_NAMES.items():
        out = out.when((cat == c) & name.rlike(f"(?i){pattern}"), 1)
    return out.otherwise(0)


def _cell(lab: Column) -> Column:
    """The cube of LAB in which a colour lies; those far outside of what screens show share the outermost ones."""
    at = lambda c: F.least(F.lit(MOST_CELL), F.greatest(F.lit(-MOST_CELL), F.floor(lab[c] / SIDE))).cast("int")
    return F.struct(*(at(c).alias(c) for c in ("l", "a", "b")))


def nearest(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """colors (with lab) and `near`: the first of the closest entries by unrounded distance. Per distinct lab.

    The palette is a grid: of each filled cell the box of its entries is known, one row of a bounded number of boxes. No
    entry of a box is nearer than the box, and each is nearer than its farthest corner. So the closest entry is in a box
    that is no farther than the nearest of all farthest corners; a colour meets the entries of those boxes alone, by cell.
    """
    keys = colors.select("lab").where(F.col("lab").isNotNull()).distinct()
    entries = palette_lab(palette).withColumn("cell", _cell(F.col("lab")))
    edges = [f(f"lab.{c}").alias(f"{n}{c}") for c in ("l", "a", "b") for n, f in (("low_", F.min), ("high_", F.max))]
    boxes = entries.groupBy("cell").agg(*edges).agg(F.collect_list(F.struct("*")).alias("boxes"))
    away = lambda b, c: F.greatest(b[f"low_{c}"] - F.col(f"lab.{c}"), F.col(f"lab.{c}") - b[f"high_{c}"], F.lit(0.0))
    across = lambda b, c: F.greatest(F.abs(b[f"low_{c}"] - F.col(f"lab.{c}")), F.abs(b[f"high_{c}"] - F.col(f"lab.{c}")))
    far = lambda b, f: F.sqrt(sum((F.pow(f(b, c), F.lit(2)) for c in ("l", "a", "b")), F.lit(0.0)))
    bounds = F.transform("boxes", lambda b: F.struct(b["cell"].alias("cell"), far(b, away).alias("least"), far(b, across).alias("most")))
    # the bounds are of other sums than distances, so they get a little room
    seen = keys.join(F.broadcast(boxes)).select("lab", bounds.alias("boxes"))
    seen = seen.withColumn("reach", F.array_min(F.col("boxes.most")) + 1e-6)
    seen = seen.select("lab", F.explode(F.filter("boxes", lambda b: b["least"] <= F.col("reach"))).alias("b")).select("lab", F.col("b.cell").alias("cell"))
    d = color.distance(F.col("lab"), F.col("q"))
    met = seen.join(entries.select("cell", "ord", "name", "hex", F.col("lab").alias("q")), "cell").select("lab", d.alias("d"), "ord", "name", "hex")
    found = met.groupBy("lab").agg(F.min_by(F.struct("d", "name", "hex"), F.struct("d", "ord")).alias("near"))
    return _with_near(colors, found, ["lab"])


#: Palettes of so many entries are gone through for every row; for larger ones each distinct colour is worked on once.
FEW_ENTRIES = 256
#: Steps between distances, from the least one upwards, that may let an entry's order or name decide: 0.5, with some room.
STEP = 0.5 + 1e-6


def with_close(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """colors (with lab) and `close`: the entries (d, name, hex), in order, of which chosen() picks; null without lab.

    The entries are sorted by distance, and those up to the first step of over 0.5 are taken. Any of these replaces any
    farther one in the fold, and none of the farther ones replaces any of these, so the fold over these has the same end.
    Mostly there is but one.
    """
    few = len(palette.select("ord").head(FEW_ENTRIES + 1)) <= FEW_ENTRIES
    rows = colors if few else colors.select("lab").where(F.col("lab").isNotNull()).distinct()

    def upto(far: Column) -> Column:
        # distances rise, so behind a step that is too long none is short enough
        last = F.aggregate(F.sort_array(far["d"]), F.array_min(far["d"]), lambda acc, d: F.when(d - acc <= STEP, d).otherwise(acc))
        return color.let(last, lambda t: F.filter(far, lambda x: (x["d"] <= t) & (x["d"] < float("inf"))))

    every = F.transform("entries", lambda x: F.struct(color.distance(F.col("lab"), x["lab"]).alias("d"), x["name"].alias("name"), x["hex"].alias("hex")))
    # one row of at most MOST_ENTRIES entries
    rows = rows.join(F.broadcast(palette_array(palette))).withColumn("close", F.when(F.col("lab").isNotNull(), color.let(every, upto))).drop("entries")
    if few:
        return rows
    found = rows.select(F.col("lab").alias("_lab"), "close")
    return colors.join(found, F.col("lab") == F.col("_lab"), "left").drop("_lab")


def chosen(rows: DataFrame) -> DataFrame:
    """rows (with close and cat) with near_name, near_hex, near_distance, by an ordered fold: an entry replaces the best so
    far if it is closer by over 0.5, or within 0.5 and its name fits the property's category better."""

    def step(acc: Column, x: Column) -> Column:
        s = _meant(x["name"], F.coalesce(F.col("cat"), F.lit("")))
        better = (x["d"] < acc["d"] - 0.5) | ((F.abs(x["d"] - acc["d"]) <= 0.5) & (s > acc["s"]))
        return F.when(better, F.struct(x["d"].alias("d"), s.alias("s"), x["name"].alias("name"), x["hex"].alias("hex"))).otherwise(acc)

    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("hex"))
    plain = lambda x: F.struct(x["d"].alias("d"), x["name"].alias("name"), x["hex"].alias("hex"))
    best = F.when(F.size("close") == 1, F.get("close", F.lit(0))).otherwise(F.aggregate("close", start, step, plain))
    # a generator, since Spark writes what a projection told into every filter on it, and so would tell it several times
    return _told(rows.select("*", F.explode_outer(F.array(best)).alias("near")).drop("close"))


def nearest_semantic(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """As nearest, but by the fold of chosen(). colors needs lab and cat."""
    return chosen(with_close(colors, palette))


def _with_near(colors: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    found = found.select(*(F.col(c).alias(f"_{c}") for c in by), "near")
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return _told(colors.join(found, on, "left").drop(*(f"_{c}" for c in by)))


def _told(out: DataFrame) -> DataFrame:
    has = F.col("near.name").isNotNull()
    return out.withColumn("near_name", F.col("near.name")).withColumn("near_hex", F.col("near.hex")).withColumn("near_distance", F.when(has, color.round2(F.col("near.d")))).drop("near")


def status(threshold: float) -> Column:
    d = F.col("near_distance")
    return F.when(d == 0, "exact").when(d <= threshold, "close").otherwise("unmatched")


def suggestion(alpha: Column) -> Column:
    told = F.when(alpha < 1, color.color_mix(F.col("near_name"), alpha)).otherwise(F.concat(F.lit("var("), F.col("near_name"), F.lit(")")))
    return F.when(F.col("status").isin("exact", "close"), told)
