"""Token counts of texts: a pre-token is tokenized once in the corpus, however often it stands in it.

A tokenizer first divides a text into pre-tokens and then cuts each of them by itself, so a text's count is the sum over
its pre-tokens of their own counts, times how often each stands there. No ids are made.

1. Each task gives the distinct pre-tokens of its documents and how often they stand in these; that is summed, and every
   distinct pre-token of the corpus is cut once. The table of them is written.
2. A second pass gives each document its pre-tokens' frequencies. Frequent pre-tokens are those that make up at least
   1 / FREQUENT of all in the corpus: there are at most FREQUENT of these, so their counts are broadcast (64 MB at most)
   and joined in place. The others move, and are joined by pre-token; none of them is hot, being under that share.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.bpe import worker_memory
from swatchline.llm.common import cut, small_batches, table
from swatchline.llm.packing import BYTE_LEVEL

#: Pre-tokens that may be broadcast, and bytes of one of them.
FREQUENT, SHORT = 1 << 20, 64
#: Distinct pre-tokens, and characters of texts, after which a task hands on what it has found.
HELD, HELD_CHARS = 200_000, 1 << 25
#: Characters whose classes don't depend on the version of Unicode that a library knows; other texts take a slower way.
SETTLED = [
    (0x0, 0x1B), (0x20, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x2500, 0x27BF), (0x3001, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF),
]


def settled_pattern() -> str:
    """BYTE_LEVEL with its classes of settled characters written out, which is faster to search."""

    def members(kind: str) -> str:
        codes = [c for a, b in SETTLED for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind]
        runs = [list(g) for _, g in itertools.groupby(enumerate(codes), lambda x: x[1] - x[0])]
        return "".join(f"\\U{g[0][1]:08x}-\\U{g[-1][1]:08x}" for g in runs)

    return BYTE_LEVEL.replace(r"\s\p{L}\p{N}", rf"\s{members('L')}{members('N')}").replace(r"\p{L}", f"[{members('L')}]").replace(r"\p{N}", f"[{members('N')}]")


class JsonPieces:
    """Pre-tokens of a file of the tokenizers library, and the number of tokens of each.

    Names of added tokens in a text count as one token each and part the text, as is the library's default. Where
    their settings let them take in neighbours, or match behind normalisation, a whole text is one piece.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(data.decode("utf-8"))
        self.own.no_truncation()
        self.own.no_padding()
        spec = json.loads(data)
        added = spec.get("added_tokens") or []
        pre = spec.get("pre_tokenizer") or {}
        odd = any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")) or (spec.get("normalizer") and any(t["normalized"] for t in added))
        self.whole = bool(odd) or self.own.pre_tokenizer is None or bool(spec["model"].get("dropout"))
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.pattern, self.unsettled = re.compile(settled_pattern()), re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        self.char_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def _part(self, text: str) -> list[str]:
        if self.plain and not self.unsettled.search(text):
            return self.pattern.findall(text)
        if self.own.normalizer is not None:
            text = self.own.normalizer.normalize_str(text)
        pieces = [p for p, _ in self.own.pre_tokenizer.pre_tokenize_str(text)]
        return [bytes(self.byte_of[c] for c in p).decode("utf-8") for p in pieces] if self.plain else pieces

    @property
    def byte_of(self) -> dict[str, int]:
        return self.__dict__.setdefault("_byte_of", {c: b for b, c in self.char_of.items()})

    def split(self, text: str) -> tuple[int, list[str]]:
        """(tokens known already, pieces that are still to be cut)."""
        if self.whole:
            return 0, [text] if text else []
        if self.added is None or not self.added.search(text):
            return 0, self._part(text)
        parts, n = self.added.split(text), len(self.added.findall(text))
        return n, [p for part in parts if part for p in self._part(part)]

    def count(self, piece: str) -> int:
        if self.whole:
            return len(self.own.encode(piece, add_special_tokens=False).ids)
        shown = "".join(map(self.char_of.__getitem__, piece.encode("utf-8"))) if self.plain else piece
        return len(self.own.model.tokenize(shown))


class ModelPieces:
    """Pre-tokens of a sentencepiece model: runs of its blank with what follows them, which no piece of it goes beyond.

    Where a piece does, or a text is normalised to more than blanks, a whole text is one piece. Its mark is a character
    before it, so that it's none of the others.
    """

    BLANK = "▁"

    def __init__(self, data: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = map(self.own.id_to_piece, range(self.own.get_piece_size()))
        self.whole = any(self.BLANK in p.lstrip(self.BLANK) for p in names)
        self.pattern = re.compile(f"{self.BLANK}+[^{self.BLANK}]*")

    def split(self, text: str) -> tuple[int, list[str]]:
        plain = self.BLANK + text.replace(" ", self.BLANK)
        if not text:
            return 0, []
        if self.whole or self.own.normalize(text) != plain:
            return 0, ["=" + text]
        return 0, self.pattern.findall(plain)

    def ids(self, piece: str) -> list[int]:
        if not piece.strip(self.BLANK):  # behind something, since an empty text gets no blank
            return self.own.encode("a" + " " * len(piece))[len(self.own.encode("a")) :]
        # encode() adds the first blank itself
        return self.own.encode(piece[1:] if piece[0] == "=" else piece[1:].replace(self.BLANK, " "))

    def count(self, piece: str) -> int:
        return len(self.ids(piece))


def pieces_of(data: bytes, kind: str):
    return JsonPieces(data) if kind == "json" else ModelPieces(data)


def _distinct(make):
    """(piece, times): the distinct pieces of a task's documents, and how often they stand in these."""

    def told(held):
        return pd.DataFrame({"piece": pd.Series(list(held), dtype=object), "times": list(held.values())})

    def run(batches):
        split, held, chars = make().split, Counter(), 0
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    held.update(split(text)[1])
                    chars += len(text)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield told(held)
                    held, chars = Counter(), 0
        yield told(held)

    return run


def _cut_pieces(make):
    def run(batches):
        count = make().count
        for pdf in batches:
            yield pdf.assign(piece=pdf["piece"].astype(object), tokens=[count(p) for p in pdf["piece"]])

    return run


def _sums(make, frequent):
    """A row for each document: what its frequent pieces sum up to, and the frequencies of the others."""

    def run(batches):
        split = make().split
        known = dict(zip(*frequent.value, strict=True))
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                total, pieces = split(text or "")
                times = Counter(pieces)
                rest = [p for p in times if p not in known]
                total += sum(known[p] * n for p, n in times.items() if p in known)
                out.append((i, len((text or "").encode("utf-8", "surrogatepass")), total, rest, [times[p] for p in rest]))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "known", "piece", "n"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    The file is one of the tokenizers library (.json) or of sentencepiece (.model); it is read by the driver and sent
    to the workers. A null text counts as empty, and has no tokens. Rows stay apart whatever their ids, null ids too;
    other columns are not read. Whole texts count, without begin, end or padding.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    kind = tokenizer_path.rsplit(".", 1)[-1]
    sent, name = spark.sparkContext.broadcast(data), f"pieces {kind} {hashlib.sha256(data).hexdigest()}"

    def make():
        return worker_memory(name, lambda: pieces_of(sent.value, kind))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    distinct = rows.select("text").mapInPandas(_distinct(make), "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))
    pieces = cut(distinct.mapInPandas(_cut_pieces(make), "piece string, times long, tokens long"))
    total = pieces.agg(F.sum("times")).first()[0] or 0
    often = (F.col("times") * frequent >= total) & (F.octet_length("piece") <= SHORT)
    head = pieces.where(often).select("piece", "tokens").toArrow()  # `frequent` rows at most
    head = spark.sparkContext.broadcast((head["piece"].to_pylist(), head["tokens"].to_pylist()))

    summed = rows.mapInPandas(_sums(make, head), "id string, n_bytes long, known long, piece array<string>, n array<long>")
    summed = cut(summed.withColumn("key", F.monotonically_increasing_id()))
    rest = summed.select("key", F.inline(F.arrays_zip("piece", "n"))).join(pieces.where(~often).select("piece", "tokens"), "piece")
    rest = rest.groupBy("key").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    n = (F.col("known") + F.coalesce("more", F.lit(0))).cast("long")
    return summed.drop("piece", "n").join(rest, "key", "left").select(F.col("id").cast("long").alias("doc_id"), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
