"""Exact top-k search by an impact-ordered, score-at-a-time index over integer vectors."""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchline.llm.common import cut, discard, small_batches, table

#: Rows of an index block, vectors of a row that moves, and impact levels of a dimension's postings.
ROWS, PIECE, LEVELS = 8192, 128, 8
#: Components of this, divided by the root of their number, may make sums that leave 64 bits.
MOST = 2.0**30
#: Shares of the postings after which a search tries its proof.
CHECKS = (0.25, 0.5, 0.7, 0.8, 0.86, 0.9, 0.94, 0.97)


def _packed(per_block: int, kind: type = np.int64):
    """Pieces of up to PIECE vectors of one length, ids and values row by row; per_block pieces have one block's name."""

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, list] = {}
        blocks: dict[int, tuple[int, int]] = {}
        name = TaskContext.get().partitionId() << 33

        def piece(dim):
            nonlocal name
            block, filled = blocks.get(dim, (0, per_block))
            if filled == per_block:
                block, filled, name = name, 0, name + 1
            blocks[dim] = (block, filled + 1)
            ids, values = zip(*held.pop(dim), strict=True)
            return {"dim": dim, "block": block, "ids": np.array(ids, np.int64).tobytes(), "v": np.stack(values).astype(kind).tobytes()}

        for pdf in batches:
            out = []
            for i, x in zip(pdf["id"], pdf["v"], strict=True):
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == PIECE:
                    out.append(piece(len(x)))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([piece(d) for d in list(held)])

    return run


class ImpactIndex:
    """Postings of a block: for each dimension all rows by falling value, cut into segments of one quantised impact."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, (self.n, self.dim) = ids, v, v.shape
        self.order = np.argsort(-v, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(v.T, self.order, axis=1)
        high, low = self.sorted[:, :1], self.sorted[:, -1:]
        level = ((high - self.sorted) * LEVELS) // np.maximum(high - low + 1, 1)
        cuts = np.stack([(level < x).sum(axis=1) for x in range(LEVELS + 1)], axis=1)
        filled = cuts[:, :-1] < cuts[:, 1:]
        self.d = np.nonzero(filled)[0]
        self.a, self.b = cuts[:, :-1][filled], cuts[:, 1:][filled]
        self.most, self.least = self.sorted[self.d, self.a], self.sorted[self.d, self.b - 1]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to k best rows other than the query's own: ids and scores, best first, ties to the smaller id.

        Impacts are contributions above the dimension's least, so they are never negative. A row's score lies
        between what it has gathered and that plus the sum of the dimensions' largest impacts yet unread. The floor
        is the k-th best whole score among the rows that lead. Reading stops when the rows that can still reach the
        floor are fewer than their share of the postings yet unread; they are scored again from their whole vectors.
        """
        w = query.astype(np.int64)
        low = np.minimum(w * self.sorted[:, 0], w * self.sorted[:, -1])
        use = np.flatnonzero(w[self.d])
        d = self.d[use]
        impact = np.maximum(w[d] * self.most[use], w[d] * self.least[use]) - low[d]
        by = np.argsort(-impact, kind="stable")
        use, d, impact = use[by], d[by], impact[by]
        a, b = self.a[use], self.b[use]
        read = np.cumsum(b - a)
        members = np.flatnonzero(self.ids != own)
        stops = np.searchsorted(read, np.multiply(CHECKS, read[-1] if len(read) else 0)) + 1 if len(members) > k else ()
        got, at, base = np.zeros(self.n, np.int64), 0, low.sum()
        segments = list(zip(d.tolist(), a.tolist(), b.tolist(), w[d].tolist(), low[d].tolist(), strict=True))
        for stop in stops:
            for i, x, y, weight, least in segments[at:stop]:
                got[self.order[i, x:y]] += weight * self.sorted[i, x:y] - least
            at = max(at, min(stop, len(segments)))
            first = np.unique(d[at:], return_index=True)[1]
            bound = base + impact[at:][first].sum()
            now = got[members]
            lead = members[np.argpartition(now, -min(len(now), 4 * k))[-4 * k :]]
            floor = np.sort(self.v[lead] @ w)[-k]
            possible = members[now + bound >= floor]
            if len(possible) <= len(members) * (1 - read[at - 1] / read[-1] if at else 1) or at == len(segments):
                members = possible
                break
        scores = self.v[members] @ w
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][best], scores[best]


def _search(k: int):
    """Rows come by block, its pieces first and then the pieces of queries that meet it; an index is built once."""

    def run(batches):
        now, pieces, index = None, [], None
        for pdf in batches:
            found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
            for r in pdf.itertuples(index=False):
                if r.block != now:
                    now, pieces, index = r.block, [], None
                part = np.frombuffer(r.ids, np.int64), np.frombuffer(r.v, np.int64).reshape(-1, r.dim)
                if not r.asks:
                    pieces.append(part)
                    continue
                if index is None:
                    index = ImpactIndex(*(np.concatenate(x) for x in zip(*pieces, strict=True)))
                    pieces = []
                for q, w in zip(*part, strict=True):
                    ids, scores = index.top(w, q, k)
                    found.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}))
            yield pd.concat(found, ignore_index=True)

    return run


def _order(score: int) -> str:
    """Tells scores apart that 64 bits can't: greater ones have greater strings. Scores within 64 bits have none."""
    if -(2**63) < score < 2**63:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):04d}{digits}"
    return "~" if score == -(2**63) else f"0{9999 - len(digits):04d}" + "".join(chr(105 - ord(c)) for c in digits)


def _search_exactly(k: int, scale: int):
    """As _search, in Python's integers: for blocks or queries with components that are too large for 64-bit sums."""

    def vectors(r):
        values = np.frombuffer(r.v, np.float64 if r.real else np.int64).reshape(-1, r.dim).tolist()
        if r.real:
            whole = lambda x: (lambda n, d: n * scale // d)(*x.as_integer_ratio())
            values = [[whole(x) for x in row] for row in values]
        return zip(np.frombuffer(r.ids, np.int64).tolist(), values, strict=True)

    def run(batches):
        now, held = None, []
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                if r.block != now:
                    now, held = r.block, []
                if not r.asks:
                    held += vectors(r)
                    continue
                for q, w in vectors(r):
                    best = heapq.nsmallest(k, ((-sum(map(operator.mul, v, w)), i) for i, v in held if i != q))
                    found += [(q, i, max(-(2**63), min(2**63 - 1, -s)), _order(-s)) for s, i in best]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k best other rows.

    Components become floor(scale * x); the score is their integer inner product, ties go to the smaller id. Vectors
    that are null, empty or hold null or non-finite components, rows with a null id, and vectors of another length than
    the query's take no part. Rows of one id are candidates each, but never of a query of that id; repeated query rows
    count once. Rows are packed into index blocks that stay where they are dealt; the queries, one row in `every`, go to
    each block in small pieces, and the k best of each block are merged by query.

    Vectors whose sums might leave 64 bits go another way, by integers of any size: each of them, and each query that
    meets them, is scored in full. Ranks follow the whole scores; a score beyond 64 bits is told as the nearest number
    that 64 bits hold.
    """
    small_batches(df.sparkSession)
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    # so that no sum of products, nor of their differences, reaches 2^62
    large = F.exists("x", lambda v: F.abs(v) * scale >= MOST / F.sqrt(F.size("x")))
    whole = rows.where(~large).select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    asks = lambda t: t.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.max("v").alias("v"))
    kind = "dim int, block long, ids binary, v binary"
    index = cut(whole.mapInPandas(_packed(ROWS // PIECE), kind))
    queries = cut(asks(whole).mapInPandas(_packed(1), kind))
    names = lambda blocks: blocks.select("dim", "block").distinct()
    met = lambda queries, blocks: queries.drop("block").join(names(blocks), "dim").withColumn("asks", F.lit(True))
    meet = index.withColumn("asks", F.lit(False)).unionByName(met(queries, index).select("dim", "block", "ids", "v", "asks")).repartition("block").sortWithinPartitions("block", "asks")
    found = cut(meet.mapInPandas(_search(k), "query_id long, vec_id long, score long")).withColumn("beyond", F.lit(""))
    wide = rows.where(large).select("id", F.col("x").alias("v"))
    if wide.head(1):
        real = lambda t, is_real=True: t.withColumn("real", F.lit(is_real))
        blocks = real(cut(wide.mapInPandas(_packed(1, np.float64), kind).withColumn("block", -1 - F.col("block"))))
        all_blocks = blocks.unionByName(real(index, False))
        asked = met(real(cut(asks(wide).mapInPandas(_packed(1, np.float64), kind))), all_blocks).unionByName(met(real(queries, False), blocks))
        meet = all_blocks.withColumn("asks", F.lit(False)).unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
        found = found.unionByName(cut(meet.mapInPandas(_search_exactly(k, scale), "query_id long, vec_id long, score long, beyond string")))
    discard(index, queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) e FROM embeddings),
s AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
