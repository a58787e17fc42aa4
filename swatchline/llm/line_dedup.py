"""Line dedup by a fixed-depth log-template tree, in DataFrame operations only.

A line's tokens are split at blanks; a token with a digit is a variable field. The tree's first level is the token
count, the next LEADING levels are the leading tokens; a leaf holds the distinct lines that agree in these, each of
them once however many texts hold it. In a leaf a token's support at a position is the number of lines that have it
there. A line's group support is the greatest number that CONSTANT of its positions reach, and must be VARIANTS at least;
positions with less than half of it are further variable fields. So lines of one make find the same template whatever
else their leaf holds: unrelated lines neither share their tokens nor outvote them. No leaf is gathered in one place.

A template recurs when min_docs different texts hold it, and so does a line as it stands, digits aside: all its lines are
dropped then, but for those of the smallest id that has it, so that no content is lost. Lines of under MIN_TOKENS tokens
are templates only as they stand, with their digits, since a number alone isn't a variable of anything; blank lines stay.
A line that is too long to recur by chance (MIN_TOKENS tokens, or LONG characters where there are fewer) recurs, with its
digits, when only min_copies different texts hold it. Exact copies of a text count once, so that copies don't make each
other's lines recur. ORACLE_SQL says the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import cut, discard, table

LEADING, CONSTANT, VARIANTS = 3, 0.7, 3
MIN_TOKENS, MIN_DOCS = 4, 3
LONG, MIN_COPIES = 20, 2
FIELD = "<*>"


def _masked(text: Column) -> Column:
    """Tokens with a digit become FIELD."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<![^ \t\r\n])[^ \t\r\n0-9]*+[0-9][^ \t\r\n]*+", FIELD)).otherwise(text)


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[ \t\r]+"), "")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, however often then and functions within it refer to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lines(keyed: DataFrame) -> DataFrame:
    """One row for each line with tokens: id, th, pos, and hashes of its tokens (line), leaf and digits (told)."""
    told = F.lit(None).cast("array<string>")  # tokens with their digits, of lines with fields
    masked = F.transform(F.split(_masked(F.col("text")), "\n"), lambda x: F.struct(_tokens(x).alias("tokens"), told.alias("told")))
    short = lambda x: F.size(x["tokens"]) < MIN_TOKENS
    with_digits = lambda x, own: F.struct(F.when(short(x), own).otherwise(x["tokens"]).alias("tokens"), F.when(~short(x), own).alias("told"))
    line = F.zip_with(masked, F.split("text", "\n"), lambda x, own: F.when(F.array_contains(x["tokens"], FIELD), with_digits(x, _tokens(own))).otherwise(x))
    rows = keyed.select("id", "th", F.posexplode(line).alias("pos", "x")).select("id", "th", "pos", "x.*").where(F.size("tokens") > 0)
    leaf = F.when(F.size("tokens") >= MIN_TOKENS, F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)))
    long = F.col("told").isNull() & ((F.size("tokens") >= MIN_TOKENS) | (F.length(F.array_join("tokens", "")) >= LONG))
    return rows.select("id", "th", "pos", F.xxhash64("tokens").alias("line"), leaf.alias("leaf"), long.alias("long"), F.when(F.col("told").isNotNull(), F.xxhash64("told")).alias("told"))


def _tokens_of(kinds: DataFrame, keyed: DataFrame) -> DataFrame:
    """(line, leaf, tokens) of the kinds of line that share their leaf with enough others, tokens as hashes.

    Their tokens are read again, from one text for each kind.
    """
    wide = kinds.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= VARIANTS).select("leaf")
    told = kinds.join(wide, "leaf").select("line", "leaf", "place.*")
    wanted = told.groupBy(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("none"), "th").agg(F.collect_list(F.struct("pos", "line", "leaf")).alias("want"))
    texts = keyed.select(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("none"), "th", "text")
    found = wanted.join(texts, ["k", "none", "th"])
    read = _bound(F.struct(F.split("text", "\n").alias("lines"), "want"), lambda b: F.transform(b["want"], lambda x: F.struct(x["line"].alias("line"), x["leaf"].alias("leaf"), F.get(b["lines"], x["pos"]).alias("told"))))
    found = found.select(F.inline(read))
    found = found.groupBy("line", "leaf").agg(F.min("told").alias("told"))
    return found.select("line", "leaf", F.transform(_tokens(_masked(F.col("told"))), lambda t: F.xxhash64(t)).alias("tokens"))


def _templates(found: DataFrame) -> DataFrame:
    """(line, template) of the lines that have fields besides those with digits, and enough support."""
    each = found.select("line", "leaf", F.posexplode("tokens").alias("i", "token"))
    support = each.groupBy("leaf", "i", "token").agg(F.count("*").alias("c"))
    whole = each.join(support, ["leaf", "i", "token"]).groupBy("line", "leaf").agg(F.sort_array(F.collect_list(F.struct("i", "token", "c"))).alias("x"))
    reach = F.ceil(F.lit(CONSTANT) * F.size("x")).cast("int")
    group = F.get(F.sort_array(F.col("x.c"), asc=False), reach - 1)
    field = lambda b, e: 2 * e["c"] < b["group"]
    shape = lambda b: F.xxhash64("leaf", F.transform(b["x"], lambda e: F.when(field(b, e), 0).otherwise(e["token"])))
    template = _bound(F.struct("x", group.alias("group")), lambda b: F.when((b["group"] >= VARIANTS) & F.exists(b["x"], lambda e: field(b, e)), shape(b)))
    return whole.select("line", template.alias("template")).where("template is not null")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_copies: int = MIN_COPIES) -> DataFrame:
    """docs with `text_col` less its dropped lines, and n_lines and n_dropped, which replace columns of these names.

    Other columns stay, whatever their names. A null text stays null with no lines; an empty text has one line, which
    stays. Rows with a null id lose their recurring lines like others, and keep one only if no row with an id has it.
    Rows of one id and text are alike.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    keyed = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    lines = cut(_lines(keyed))

    place = F.struct("id", "th", "pos")
    by_text = lines.groupBy("line", "leaf", "long", "th").agg(F.min("id").alias("id"), F.min(place).alias("place"))
    kinds = cut(by_text.groupBy("line", "leaf", "long").agg(F.count("*").alias("texts"), F.min("id").alias("first"), F.min("place").alias("place")))
    exact = kinds.where(F.col("texts") >= F.when(F.col("long"), F.least(F.lit(min_copies), F.lit(min_docs))).otherwise(min_docs)).select("line", "first")

    found = cut(_tokens_of(kinds, keyed))
    groups = cut(_templates(found))
    discard(found)
    held = lines.join(groups, "line").groupBy("template").agg(F.countDistinct("th").alias("c"), F.min("id").alias("first")).where(F.col("c") >= min_docs).select("template", "first")
    dropped = exact.unionByName(groups.join(held, "template").select("line", "first")).groupBy("line").agg(F.min("first").alias("first"))
    out = lines.join(dropped, "line").select("id", "th", "pos", "first")
    told = lines.where(F.col("told").isNotNull()).select("id", "th", "pos", "told")
    copies = told.groupBy("told").agg(F.countDistinct("th").alias("c"), F.min("id").alias("first")).where(F.col("c") >= min_copies).select("told", "first")
    out = out.unionByName(told.join(copies, "told").select("id", "th", "pos", "first")).where(~F.col("id").eqNullSafe(F.col("first")))

    key = lambda: (F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("none"), "th")
    out = cut(out.groupBy(*key()).agg(F.collect_set("pos").alias("gone")))
    rows = keyed.select("row", "text", *key()).join(out, ["k", "none", "th"], "left")
    text = F.split("text", "\n")
    kept = _bound(F.struct(text.alias("lines"), "gone"), lambda b: F.transform(F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), b["gone"]), lambda i: F.get(b["lines"], i)))
    names = [F.col(f"row.`{c}`").alias(c) if c != text_col else F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*names, F.coalesce(F.size(text), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, doc_id, text, string_split(text, chr(10)) ls FROM d),
l AS (SELECT rid, doc_id, text, unnest(ls) line, unnest(range(len(ls))) pos FROM s),
k AS (SELECT rid, doc_id, text, pos, list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '') w FROM l),
m0 AS (SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) x FROM k WHERE len(w) > 0),
m AS (SELECT rid, doc_id, text, pos, w AS told, CASE WHEN len(w) < {MIN_TOKENS} THEN w ELSE x END w, len(w) >= {MIN_TOKENS} AND list_contains(x, '{FIELD}') fields, len(w) n FROM m0),
c AS (SELECT w, any_value(n) n, count(DISTINCT text) texts, min(doc_id) AS first, bool_or(NOT fields AND (n >= {MIN_TOKENS} OR length(array_to_string(w, '')) >= {LONG})) long FROM m GROUP BY w),
f AS (SELECT w, n, [n::VARCHAR] || w[1:{LEADING}] leaf FROM c WHERE n >= {MIN_TOKENS}),
v AS (SELECT w, n, leaf, unnest(w) token, unnest(range(n)) i FROM f),
u AS (SELECT *, count(*) OVER (PARTITION BY leaf, i, token) support FROM v),
p AS (SELECT w, leaf, list(support ORDER BY support DESC)[ceil({CONSTANT}::DOUBLE * any_value(n))::BIGINT] needed FROM u GROUP BY w, leaf),
q AS (SELECT u.w, u.leaf, list(CASE WHEN 2 * support < needed THEN NULL ELSE token END ORDER BY i) shape FROM u JOIN p USING (w, leaf) WHERE needed >= {VARIANTS} GROUP BY u.w, u.leaf HAVING bool_or(2 * support < needed)),
g AS (SELECT leaf, shape, min(doc_id) AS first FROM m JOIN q USING (w) GROUP BY leaf, shape HAVING count(DISTINCT text) >= {MIN_DOCS}),
t AS (SELECT w, min(first) AS first FROM (SELECT w, first FROM c WHERE texts >= CASE WHEN long THEN {MIN_COPIES} ELSE {MIN_DOCS} END UNION ALL SELECT q.w, g.first FROM q JOIN g ON q.leaf = g.leaf AND q.shape = g.shape) GROUP BY w),
y AS (SELECT told, min(doc_id) AS first FROM m WHERE fields GROUP BY told HAVING count(DISTINCT text) >= {MIN_COPIES}),
r AS (SELECT rid, pos FROM m JOIN t USING (w) WHERE m.doc_id IS DISTINCT FROM t.first UNION SELECT rid, pos FROM m JOIN y USING (told) WHERE fields AND m.doc_id IS DISTINCT FROM y.first),
o AS (SELECT l.rid, count(*) n_lines, count(r.rid) n_dropped, string_agg(CASE WHEN r.rid IS NULL THEN l.line END, chr(10) ORDER BY l.pos) kept FROM l LEFT JOIN r USING (rid, pos) GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE d.text END text, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_dropped, 0)::BIGINT n_dropped FROM d LEFT JOIN o USING (rid)
"""
