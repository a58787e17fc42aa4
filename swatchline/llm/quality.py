"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Paths of small trees, grown on random parts of the training rows and statistics, are conjunctive rules. A lasso
logistic regression gives most rules weight 0; the others are compiled into one Spark column expression.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import small_batches, table
from swatchline.llm.language import held_out

#: The classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO, STEPS, SEED = 40, 3, 0.002, 1500, 7

STATISTICS = ["log_chars", "word_length", "distinct_words", "top_word", "upper", "digit", "symbol", "bang", "bar", "space", "punctuation", "other", "line_words", "distinct_lines", "short_words", "long_words", "upper_words", "marked_words"]
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b"*$%&#@^~+=<>{}[]\\_")] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("|")] = 5
_CLASS[list(b" \t\r\n")] = 6
_CLASS[list(b".,;:?'\"()-/")] = 7
_CLASS[128:] = 8


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text; shares are of bytes, words or lines. A null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[1:] / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, count = max(1, len(words)), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    top = max(count.values(), default=0)
    ends = Counter(w[-1] for w in words)
    marked = sum(c for x, c in ends.items() if x in "*$%&#@!|")
    return [float(np.log1p(len(raw))), float(lengths.sum() / n), len(count) / n, top / n, *share.tolist(), n / len(lines), len(set(lines)) / len(lines), float((lengths <= 2).sum() / n), float((lengths >= 16).sum() / n), sum(c for w, c in count.items() if w.isupper()) / n, marked / n]


def _statistics_udf():
    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS)

    return udf.asNondeterministic()  # so that it runs once a row, wherever its fields are used


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a struct `_stats` of the statistics of a text."""
    small_batches(docs.sparkSession)
    return docs.withColumn("_stats", _statistics_udf()(F.col(text_col)))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold), all of which hold


def _paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: Rule = ()) -> list[Rule]:
    out = [path] if path else []
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return out
    best = None
    for c in columns:
        v = x[rows, c]
        order = np.argsort(v, kind="stable")
        v, good = v[order], np.cumsum(y[rows][order])
        n, total = len(v), good[-1]
        left = np.arange(1, n)
        split = (v[1:] > v[:-1]) & (left >= 5) & (n - left >= 5)
        if not split.any():
            continue
        a, b = good[:-1] / left, (total - good[:-1]) / (n - left)
        impurity = left * a * (1 - a) + (n - left) * b * (1 - b)
        at = np.argmin(np.where(split, impurity, np.inf))
        if best is None or impurity[at] < best[0] - 1e-12:
            best = (impurity[at], c, float((v[at] + v[at + 1]) / 2))
    if best is None:
        return out
    _, c, threshold = best
    above = x[rows, c] > threshold
    for side in (False, True):
        out += _paths(x, y, rows[above == side], columns, depth - 1, (*path, (int(c), side, threshold)))
    return out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, threshold in rule:
        out &= (x[:, c] > threshold) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept, and rules with their weights, by proximal gradient steps with momentum. Without rows: 0 and none."""
    if not len(y):
        return 0.0, []
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), 3000), replace=False)
        some = rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False)
        rules |= dict.fromkeys(_paths(x, y, rows, some, DEPTH))
    names = list(rules)
    if not names:
        return base, []
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in names:  # of rules that hold for the same rows the first
        holds = _holds(rule, x)
        columns.setdefault(np.packbits(holds).tobytes(), (rule, holds))
    names = [rule for rule, _ in columns.values()]
    a = np.empty((len(y), len(names)))
    for i, (_, holds) in enumerate(columns.values()):
        a[:, i] = holds
    step = 4 * len(y) / (np.linalg.eigvalsh(a.T @ a)[-1] + len(y))
    w, b, z, c, t = np.zeros(a.shape[1]), base, np.zeros(a.shape[1]), base, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ z + c, -30, 30)))
        g = (p - y) / len(y)
        new = z - step * (a.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        free, later = c - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / later * (new - w), free + (t - 1) / later * (free - b)
        w, b, t = new, free, later
    return float(b), [(names[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble's probability as a column of the fields of `_stats`."""
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = F.lit(True)
        for c, above, threshold in rule:
            s = F.col(f"_stats.{STATISTICS[c]}")
            holds = holds & (s > threshold if above else s <= threshold)
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[float, list[tuple[Rule, float]]]:
    """Rules from at most FIT_ROWS labelled rows. Null labels teach nothing; of several the mean counts.

    Of rows that share an id one counts, that with the least statistics, so that copies of one don't crowd out others.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_doc"), "_doc").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).join(F.broadcast(known), "_doc")
    got = with_statistics(rows, "_t").groupBy("_doc").agg(F.first("_y").alias("_y"), F.min("_stats").alias("_stats")).select("_doc", "_y", "_stats.*").orderBy("_doc").toPandas()  # at most FIT_ROWS rows
    return fit_rules(got[STATISTICS].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, model: tuple[float, list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, that the label is 1) and predicted of every row; empty and null texts are scored alike."""
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "_t")
    return rows.select("doc_id", compiled(*model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~F.coalesce(held_out("doc_id"), F.lit(False)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
