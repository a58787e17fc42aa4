"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed over all training documents; the log-probability matrix (languages by
BUCKETS) is sent to the workers, which score batches of documents with numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import small_batches, table
from swatchline.llm.shingles import blocks

BUCKETS, ORDERS, SMOOTH = 1 << 15, (2, 3), 0.5
#: More languages than this would make the matrix larger than 64 MB; the fit then fails rather than drops any.
MOST_LANGUAGES = 512
#: Places in which the counts of one language are summed before they meet.
SPREAD = 64


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the lower-cased texts; none spans two texts."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in lower], np.int64)
    number = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    numbers, buckets = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        whole = number[:m] == number[n - 1 :]
        numbers.append(number[:m][whole])
        buckets.append((h >> np.uint32(17))[whole].astype(np.int64))
    if not numbers:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(buckets)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for pdf in batches:
        texts, langs = pdf["text"].tolist(), pdf["lang"].tolist()
        for a, b in blocks(texts):
            part = [(t, x) for t, x in zip(texts[a:b], langs[a:b], strict=True) if has_letter(t)]
            names = sorted({x for _, x in part})
            which = np.array([names.index(x) for _, x in part], np.int64)
            number, bucket = ngram_buckets([t for t, _ in part])
            counts = np.bincount(which[number] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS) if len(names) else []
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + counts[k]
                docs[name] = docs.get(name, 0) + int((which == k).sum())
    yield pd.DataFrame([(x, docs[x], zlib.compress(total[x].astype(np.int64).tobytes(), 1)) for x in total], columns=["lang", "n", "counts"])


def _sum_counts(batches):
    """Sums of the languages that a task gets; it holds one array for each, however many rows add to it."""
    total: dict[str, list] = {}
    for pdf in batches:
        for lang, n, x in zip(pdf["lang"], pdf["n"].tolist(), pdf["counts"], strict=True):
            held = total.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
            held[0] += n
            held[1] += np.frombuffer(zlib.decompress(x), np.int64)
    yield pd.DataFrame([(x, n, zlib.compress(c.tobytes(), 1)) for x, (n, c) in total.items()], columns=["lang", "n", "counts"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities, log-priors) from all rows whose language isn't null and whose text has a letter."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInPandas(_counts, "lang string, n long, counts binary")
    kind = "lang string, n long, counts binary"
    # a language's arrays are summed in SPREAD places first, so that no task gets those of all tasks
    parts = parts.repartition("lang", F.pmod(F.xxhash64("counts"), F.lit(SPREAD))).mapInPandas(_sum_counts, kind)
    summed = parts.repartition("lang").mapInPandas(_sum_counts, kind).limit(MOST_LANGUAGES + 1).collect()
    if len(summed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    summed.sort(key=lambda r: r.lang)
    if not summed:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    counts = np.stack([np.frombuffer(zlib.decompress(r.counts), np.int64) for r in summed]) + SMOOTH
    priors = np.array([r.n for r in summed], float)
    return [r.lang for r in summed], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(priors / priors.sum())


def _score(model):
    def run(batches):
        langs, weights, priors = model.value
        by_bucket = np.ascontiguousarray(weights.T)
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for a, b in blocks(texts, 1 << 19):
                part = texts[a:b]
                known = np.array([bool(langs) and has_letter(t) for t in part])
                pred, score = np.full(b - a, "und", object), np.zeros(b - a)
                if known.any():
                    number, bucket = ngram_buckets([t if k else "" for t, k in zip(part, known, strict=True)])
                    logs = np.stack([np.bincount(number, by_bucket[bucket, k], minlength=b - a) for k in range(len(langs))], axis=1) + priors
                    top = logs.max(axis=1, keepdims=True)
                    share = 1 / np.exp(logs - top).sum(axis=1)
                    best = logs.argmax(axis=1)
                    pred[known] = np.array(langs, object)[best[known]]
                    score[known] = share[known]
                yield pd.DataFrame({"doc_id": ids[a:b], "lang_pred": pred, "score": score})

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the likeliest language and its posterior.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Rows stay apart whatever
    their ids.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(held_out("doc_id"), F.lit(False))))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
