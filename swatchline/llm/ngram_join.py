"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets A and B of distinct word shingles. The result is
the components of the links. Links within a component are not listed or counted: a group of m near copies has up to
m * m / 2 of them, and the work here stays in proportion to m but for the comparison of signatures in step 5.

1. A pass over the texts gives each its set's size, a 128-bit digest and a signature, and counts all shingles in a
   sketch. The sketch has a counter for each SLOT_LOAD shingles, as the bytes of the text foretell their number, and
   MOST_SLOTS (64 MB) at most. Equal sets form a class; its smallest id stands for it.
2. Shingles are ordered rarest first by their counters, the same order for all sets. Linked sets share a shingle of
   their prefixes, the first n - ceil(0.75 n) + 1. A second pass deals out the prefixes by shingle; shingles that one
   class alone has go. A task tells a set once, so copies don't make a shingle's group large.
3. In each group the member that has the fewest rarer shingles is the head: the one that its near copies changed least
   from. Each member tries the head that most of its groups have, and verified pairs give components.
4. Verification moves texts: a head's, and those of the members that try it, meet in one place, and every text is made
   a set once. Heads with many members are split, and the head's text goes to every part.
5. Groups that still hold several components compare the signatures of the members outside of their head's
   component with those of all members, in numpy, by blocks of members. Each such member first tries the nearest
   other; then all pairs of different components that the filters leave are verified. A pair within one component can't
   change it, so no link between components is lost. No pair is verified twice, in one step or in several.

Length filter: 4 * n_small >= 3 * n_large. Positional filter: a shingle shared at positions i and j bounds the
overlap by min(i, j) + min(n_a - i, n_b - j). Suffix filter: sets are divided at fixed values into PARITIES parts;
each part whose sizes differ in parity holds a shingle of one set alone, which bounds the distance of the whole sets.
Sets that are unlike in more than a few hundred shingles differ in half of these parts at most, so each set has finer
parts too (`more`), at least FINER for each shingle up to MOST_PARITIES. They are folded to the coarser of a pair's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchline.llm.common import LATE_BROADCAST, components, cut, discard, held, small_batches, table
from swatchline.llm.shingles import blocks, mix, shingle_sets

SLOT_LOAD, LEAST_SLOTS, MOST_SLOTS, CHUNK = 64, 1 << 16, 1 << 24, 1 << 12
#: Chunks of the sketch that one job brings to the driver: 8 MB before they are packed.
BROUGHT = 512
#: A counter of at least so many, and of HOT_LOAD times the mean, may stand for a hot shingle; its group is split.
HOT, HOT_LOAD, SALTS = 20_000, 8, 64
PARITIES = 512
FINER, MOST_PARITIES = 4, 8192
#: Members of a group that are compared in one place, and members that meet one copy of their head's text.
BLOCK, STAR = 2048, 2000
#: Digests that a task remembers in order to tell a set once.
REMEMBERED = 200_000


def _slot(value: np.ndarray, slots: int) -> np.ndarray:
    return (value >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _digests(value: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A digest of each of the sets whose sizes are n and whose elements follow each other in value."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(value, seed), dtype=np.uint64)))
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]).view(np.int64)


def _finer_parities(value: np.ndarray) -> bytes:
    """Parities of a set's sizes in its finer parts; part p of coarser ones holds the parts that leave p modulo their number."""
    parts = min(MOST_PARITIES, max(PARITIES, 1 << (FINER * len(value) - 1).bit_length()))
    odd = np.bincount((value & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _finer_apart(more, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the parts of the coarser one the sets a and b of each pair differ in parity."""
    size = np.array([len(x) for x in more])
    least, out = np.minimum(size[a], size[b]), np.zeros(len(a), np.int64)
    for s in np.unique(least):
        pairs = np.flatnonzero(least == s)
        for at in np.array_split(pairs, -(-len(pairs) // 20_000)):
            used, where = np.unique(np.concatenate((a[at], b[at])), return_inverse=True)
            bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(more[u], np.uint64).reshape(-1, s // 8), axis=0) for u in used])
            out[at] = np.bitwise_count(bits[where[: len(at)]] ^ bits[where[len(at) :]]).sum(axis=1, dtype=np.int64)
    return out


def _summaries(k: int, slots: int):
    def run(batches):
        counts = np.zeros(slots, np.uint32)
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            for a, b in blocks(texts):
                number, value = shingle_sets(texts[a:b], k)
                seen, times = np.unique(_slot(value, slots), return_counts=True)
                counts[seen] += times.astype(np.uint32)
                n = np.bincount(number, minlength=b - a)
                part = number * PARITIES + (value & np.uint64(PARITIES - 1)).astype(np.int64)
                odd = np.bincount(part, minlength=PARITIES * (b - a)).reshape(b - a, PARITIES) & 1
                words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                yield pd.DataFrame({"id": ids[a:b], "n": n, "k1": _digests(value, n, 3), "k2": _digests(value, n, 4), "odd": list(words), "more": [_finer_parities(x) for x in np.split(value, np.cumsum(n)[:-1])], "chunk": -1, "counts": None})
        parts = [(c, counts[c * CHUNK : (c + 1) * CHUNK]) for c in range(slots // CHUNK)]
        parts = [(c, zlib.compress(x.tobytes(), 1)) for c, x in parts if x.any()]
        yield pd.DataFrame({"id": None, "n": 0, "k1": 0, "k2": 0, "odd": None, "more": None, "chunk": [c for c, _ in parts], "counts": [x for _, x in parts]})

    return run


def _add_chunks(batches):
    """Sums of the chunks that a task gets; it holds its share of the sketch, however many rows add to it."""
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for c, x in zip(pdf["chunk"].tolist(), pdf["counts"], strict=True):
            total[c] = total.get(c, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64)
    yield pd.DataFrame([(c, zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1)) for c, x in total.items()], columns=["chunk", "counts"])


def _prefixes(k: int, slots: int, sketch, hot: int):
    def run(batches):
        count = np.frombuffer(sketch.value, np.uint32)
        told: set[tuple[int, int]] = set()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in blocks(texts):
                number, value = shingle_sets(texts[a:b], k)
                n = np.bincount(number, minlength=b - a)
                digest = _digests(value, n, 3)
                new = np.zeros(b - a, bool)
                for d, key in enumerate(zip(n.tolist(), digest.tolist(), strict=True)):
                    if key not in told:
                        if len(told) >= REMEMBERED:
                            told.clear()
                        told.add(key)
                        new[d] = True
                weight = count[_slot(value, slots)]
                order = np.lexsort((value, weight, number))
                place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
                keep = (place < (n - (3 * n + 3) // 4 + 1)[number]) & new[number]
                order, doc = order[keep], number[keep]
                yield pd.DataFrame({"token": value[order].view(np.int64), "n": n[doc], "k1": digest[doc], "i": place[keep], "hot": weight[order] >= hot})

    return run


def _verify(k: int):
    """Links (id, head) among rows (head, part, id, text) that come by head and part, the head's own text first."""

    def run(batches):
        now, heads = None, []
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            keys, ids = list(zip(pdf["head"].tolist(), pdf["part"].tolist(), strict=True)), pdf["id"].tolist()
            for a, b in blocks(texts):
                number, value = shingle_sets(texts[a:b], k)
                sets = np.split(value, np.cumsum(np.bincount(number, minlength=b - a))[:-1])
                for at, mine in enumerate(sets, a):
                    if keys[at] != now:
                        now, heads = keys[at], []
                    if ids[at] == now[0]:
                        heads.append(mine)
                        continue
                    for own in heads:
                        place = np.searchsorted(own, mine)
                        both = int((own[np.minimum(place, len(own) - 1)] == mine).sum()) if len(own) else 0
                        if 7 * both >= 3 * (len(own) + len(mine)) > 0:
                            out.append((ids[at], now[0]))
                            break
            yield pd.DataFrame(out, columns=["id", "head"], dtype="int64")

    return run


def _once(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Pairs (id, head) that stand in no frame of tried, each pair once, whichever of its two is the head."""
    ends = (F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    pairs = pairs.groupBy(*ends).agg(F.min("head").alias("head"))
    for before in tried:
        pairs = pairs.join(before.select(*ends), ["a", "b"], "left_anti")
    return pairs.select(F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id"), "head")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Those of a written frame of distinct pairs (id, head) of classes that link; texts has each class's document."""
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    want = pairs.join(parts, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    want = want.unionByName(parts.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    # written before they meet texts: then Spark knows their size, and few of them don't make all texts move
    want = cut(want.join(texts, "id"))
    # the comparison, always true, tells Spark that it pays to filter all texts by the keys of these few
    rows = docs.join(want.where("part >= 0"), "doc").repartition("head", "part").sortWithinPartitions("head", "part", F.col("id") != F.col("head"))
    links = cut(rows.select("head", "part", "id", "text").mapInPandas(_verify(k), "id long, head long").distinct())
    discard(want)
    return links


def _near(n_a, n_b, i, j):
    """The length and the positional filter; the overlap o is enough when 7 o >= 3 (n_a + n_b)."""
    return (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)) & (7 * (F.least(i, j) + F.least(n_a - i, n_b - j)) >= 3 * (n_a + n_b))


def _apart(a, b):
    return sum((F.bit_count(F.get(a, F.lit(x)).bitwiseXOR(F.get(b, F.lit(x)))) for x in range(PARITIES // 64)), F.lit(0))


def _compare(nearest: bool):
    """Pairs (id, head) of different labels that the filters leave, in groups of rows that come by token and block.

    Rows with out stand for members outside of the main label, which meet all rows without it. nearest: only the
    closest partner of each, by the share of parts that differ.
    """
    names = ["token", "block", "id", "n", "i", "label", "out"]

    def pairs(cols, odd, more):
        key = cols["token"] * 31 + cols["block"]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        base = np.bincount(run[~cols["out"]], minlength=len(starts))  # rows without out come first in a run
        left = np.flatnonzero(cols["out"])
        many = base[run[left]]
        ends = np.cumsum(many)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
            m = many[at:to]
            a = np.repeat(left[at:to], m)
            b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[run[left[at:to]]], m)
            at = to
            n_a, n_b, i, j = cols["n"][a], cols["n"][b], cols["i"][a], cols["i"][b]
            ok = (cols["label"][a] != cols["label"][b]) & (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b))
            ok &= 7 * (np.minimum(i, j) + np.minimum(n_a - i, n_b - j)) >= 3 * (n_a + n_b)
            a, b, both = a[ok], b[ok], (n_a + n_b)[ok]
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            ok = 7 * apart <= both
            a, b, both = a[ok], b[ok], both[ok]
            apart = _finer_apart(more, a, b)
            ok = 7 * apart <= both
            a, b, share = a[ok], b[ok], apart[ok] / both[ok]
            if nearest and len(a):
                order = np.lexsort((cols["id"][b], share, a))
                first = np.concatenate(([True], a[order][1:] != a[order][:-1]))
                a, b, share = a[order][first], b[order][first], share[order][first]
            yield pd.DataFrame({"id": cols["id"][a], "head": cols["id"][b], "share": share})

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < 20_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["token"].to_numpy() != rows["token"].iloc[-1]) | (rows["block"].to_numpy() != rows["block"].iloc[-1])
            end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if end:
                yield from _told(rows.iloc[:end])
            held, size = [rows.iloc[end:]], len(rows) - end
        if size:
            yield from _told(pd.concat(held, ignore_index=True))

    def _told(rows):
        yield from pairs({c: rows[c].to_numpy() for c in names}, np.stack(rows["odd"].to_numpy()).view(np.uint64), rows["more"].tolist())

    return run


def _labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n, odd, more, label): the label is the component by the links so far, or the id itself."""
    labels = components(links.select(F.col("id").alias("src"), F.col("head").alias("dst")))
    return cut(ids.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "odd", "more", F.coalesce("component", "id").alias("label")))


def _rest(members: DataFrame, state: DataFrame, nearest: bool, tried: list[DataFrame]) -> DataFrame:
    """Pairs (id, head) of different labels that share a group, pass the filters and weren't tried, each of them once."""
    named = members.join(state.select("id", "label"), "id")
    groups = named.groupBy("token").agg(F.min_by("label", F.struct("i", "id")).alias("main"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"))
    # of groups with the same members one is enough: any shared shingle may bound their overlap
    groups = groups.where("low <> high").groupBy("c", "who").agg(F.min_by(F.struct("token", "main", "c"), "token").alias("g")).select("g.*")
    rows = cut(members.join(groups, "token").join(state.select("id", "odd", "more", "label"), "id").select("token", "id", "n", "i", "label", "odd", "more", (F.col("label") != F.col("main")).alias("out"), F.ceil(F.col("c") / BLOCK).cast("int").alias("s")))
    one = rows.select("token", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("block"), "id", "n", "i", "label", "odd", "more", F.lit(False).alias("out"))
    other = rows.where("out").select("token", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("block"), "id", "n", "i", "label", "odd", "more", "out")
    cells = one.unionByName(other).repartition("token", "block").sortWithinPartitions("token", "block", "out")
    found = cells.mapInPandas(_compare(nearest), "id long, head long, share double")
    if nearest:
        found = found.groupBy("id").agg(F.min_by("head", F.struct("share", "head")).alias("head"))
    pairs = cut(_once(found.select("id", "head"), tried), batch=10_000)
    discard(rows)
    return pairs


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Null or blank texts have no shingles and link with nothing. A row with a null id gets a null component. Rows
    with one id count as one document that links if any of its texts does. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    with held(docs.sparkSession, {LATE_BROADCAST: "-1"}):
        return _linked(docs, id_col, text_col, k, hot)


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size // 6 // SLOT_LOAD).bit_length()))
    out = cut(docs.select(F.col("doc").cast("string").alias("id"), "text").mapInPandas(_summaries(k, slots), "id string, n long, k1 long, k2 long, odd array<long>, more binary, chunk int, counts binary"))
    rows = out.where("chunk < 0").select(F.col("id").cast("long").alias("doc"), "n", "k1", "k2", "odd", "more")
    chunks = cut(out.where("chunk >= 0").select("chunk", "counts").repartition("chunk").mapInPandas(_add_chunks, "chunk int, counts binary"))
    counts = np.zeros(slots, np.uint32)
    for at in range(0, slots // CHUNK, BROUGHT):  # MOST_SLOTS counters at most; by their number, not a job for each partition
        for c, x in chunks.where(F.col("chunk").between(at, at + BROUGHT - 1)).collect():
            counts[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(zlib.decompress(x), np.uint32)
    discard(chunks)
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    filled = rows.where("n > 0 and doc is not null")
    classes = filled.groupBy("n", "k1", "k2").agg(F.min("doc").alias("doc"), F.any_value("odd").alias("odd"), F.any_value("more").alias("more"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    texts = classes.select("id", "doc")

    known = docs.where("doc is not null").select("text").mapInPandas(_prefixes(k, slots, sketch, max(hot, HOT_LOAD * int(counts.mean()))), "token long, n long, k1 long, i int, hot boolean")
    members = cut(_grouped(known).join(classes.select("n", "k1", "id"), ["n", "k1"]).select("token", "id", "n", "i"), batch=10_000)
    state = classes.select("id", "n", "odd", "more")

    heads = members.groupBy("token").agg(F.min(F.struct("i", "id", "n")).alias("h"))
    pairs = members.join(heads, "token").where((F.col("id") != F.col("h.id")) & _near(F.col("n"), F.col("h.n"), F.col("i"), F.col("h.i")))
    pairs = pairs.groupBy("id", F.col("h.id").alias("head")).agg(F.count("*").alias("votes")).groupBy("id").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("head"))
    for end in ("id", "head"):
        pairs = pairs.join(state.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("odd").alias(f"{end}_odd")), end)
    pairs = pairs.where(7 * _apart(F.col("id_odd"), F.col("head_odd")) <= F.col("id_n") + F.col("head_n")).select("id", "head")
    tried = [cut(_once(pairs, []))]
    links = _verified(tried[0], docs, texts, k)

    # rows of one id with different texts tie their classes together
    again = filled.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc")
    tied = filled.join(again, "doc").join(classes.select("n", "k1", "k2", "id"), ["n", "k1", "k2"]).select("doc", "id").distinct()
    tied = tied.join(tied.groupBy("doc").agg(F.min("id").alias("head")), "doc").where("id <> head").select("id", "head")
    links = cut(links.unionByName(tied))
    now = _labelled(state, links)
    for nearest in (True, False):
        tried.append(_rest(members, now, nearest, tried))
        more = _verified(tried[-1], docs, texts, k)
        if more.head(1):
            links = links.unionByName(more)
            discard(now)
            now = _labelled(state, links)
    discard(members, *tried)
    labels = now.join(texts, "id").select("id", "doc", "label")
    labels = labels.join(labels.groupBy("label").agg(F.min("doc").alias("component")), "label").select("id", "component")
    found = filled.join(classes.select("n", "k1", "k2", "id"), ["n", "k1", "k2"]).join(labels, "id").groupBy("doc").agg(F.min("component").alias("component"))
    return rows.join(found, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _grouped(prefix: DataFrame) -> DataFrame:
    """(token, n, k1, i) of the shingles that at least two classes have in their prefixes, one row for each class.

    Rows of a hot shingle are dealt out by class too; they all stay, since another part may hold a second class.
    """
    by, me = Window.partitionBy("token", "salt").orderBy("n", "k1"), F.struct("n", "k1")
    rows = prefix.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int")).otherwise(-1))
    rows = rows.select("token", "n", "k1", "i", "hot", me.alias("me"), F.lag(me).over(by).alias("lag"), F.lead(me).over(by).alias("lead"), F.first(me).over(by).alias("first"))
    # a group's first class shows by its last row, the others by their first
    return rows.where("(lag is not null and lag <> me) or (first = me and (hot and lag is null or not hot and lead is not null and lead <> me))").select("token", "n", "k1", "i")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT rid, x FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) x FROM d)),
n AS (SELECT rid, doc_id, count(*) c FROM s JOIN d USING (rid) GROUP BY rid, doc_id),
p AS (SELECT a.rid a, b.rid b, count(*) o FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT na.doc_id u, nb.doc_id v FROM p JOIN n na ON na.rid = p.a JOIN n nb ON nb.rid = p.b WHERE na.doc_id IS NOT NULL AND nb.doc_id IS NOT NULL AND 100 * o >= 75 * (na.c + nb.c - o)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE e.v > r.root),
m AS (SELECT doc_id, min(root) component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT n_shingles, m.component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.doc_id = d.doc_id
"""
