"""Token counts, token alignment and the filter audit, against libraries, plain versions and the SQL."""

import base64
import hashlib
import itertools
import json
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from swatchline.llm import filter_audit, token_align, token_counts

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, piece string, pair long, key long, id long, mask int, part string"
SPECIAL = "<|endoftext|>"
#: Nulls, blanks, repeated rows, special names, odd spacing and characters of many kinds.
EDGE = [
    (0, None), (1, ""), (2, " "), (3, "a"), (4, "the the  the   the\n\n the\t"), (5, "it's we'll don't 'sx"), (6, f"a {SPECIAL}b{SPECIAL}{SPECIAL} c"), (7, SPECIAL),
    (8, "▁x ▁ y"), (9, "  two  blanks "), (10, "字字 かな 한글 é ñ 😀 ͸ \U0001f9ff ‍ \xa0x"), (11, "<s> </s> <0x41> <unk>"), (4, "the the  the   the\n\n the\t"), (4, "another text"),
    (None, "no id"), (None, "no id"), (12, "x" * 5000), (13, "ab1-" * 3000), (14, "".join(map(chr, range(1, 700)))), (15, "=" * 3000 + " " * 3000), (16, "\r\n" * 50), (17, SPECIAL[:-1] + SPECIAL),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "p", 1, 2, 3, 4, "q") for i, t in rows], DOCS)


def table_rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("frequent", [4, token_counts.FREQUENT])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name, frequent, monkeypatch):
    """Against the library; with hardly any pre-token broadcast, and many hand-overs, too."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    if frequent == 4:
        monkeypatch.setattr(token_counts, "HELD", 50)
    rows = EDGE + table_rows(spark)
    got = token_counts.count_tokens(docs(spark, rows), path, frequent=frequent, limit=20)
    want = [(i, len((t or "").encode()), n, n > 20) for i, t in rows for n in [count(t or "")]]
    same(map(tuple, got.collect()), want)


def test_settled_characters():
    """The classes of characters of the fast way are those of the library, in two contexts."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        pieces = token_counts.JsonPieces(f.read())
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        text = f"a{c}b {c}{c} 1{c}  {c}!{c}\n{c} "
        if not pieces.unsettled.search(text):
            shown = [p for p, _ in pieces.own.pre_tokenizer.pre_tokenize_str(text)]
            assert shown == ["".join(pieces.char_of[b] for b in p.encode()) for p in pieces.pattern.findall(text)]


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("false")
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert token_counts.count_tokens(none, a).count() == 0
    assert token_align.align_tokens(none, a, b).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).count() == 0


def aligned(rows):
    """The plain version: ends as sets, groups and links by loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    told, held = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
            if all(b"".join(r) == (" " + t).encode() for r in raw):
                ends = [list(itertools.accumulate(map(len, r))) for r in raw]
                last = (0, 0)
                for end in sorted(set(ends[0]) & set(ends[1])):
                    now = ends[0].index(end, last[0]) + 1, ends[1].index(end, last[1]) + 1
                    groups.append((ids[0][last[0] : now[0]], ids[1][last[1] : now[1]]))
                    last = now
        links = Counter(p for x, y in groups for p in itertools.product(x, y))
        held.update(set(links))
        told.append((i, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for i, groups, links in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("frequent", [3, token_align.FREQUENT])
def test_token_alignment(spark, frequent, monkeypatch):
    """Against the plain version; with few links at once and hardly any pair broadcast, too."""
    if frequent == 3:
        monkeypatch.setattr(token_align, "LINKS", 5)
        monkeypatch.setattr(token_align, "HELD", 1000)
    rows = EDGE + table_rows(spark)[:120]
    got = token_align.align_tokens(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), frequent=frequent)
    same(map(tuple, got.collect()), aligned(rows))


def audited(docs, labels):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    return con.sql(filter_audit.ORACLE_SQL)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, monkeypatch):
    random.seed(5)
    words = [random.choice("abcdefgh") * random.randint(1, 5) for _ in range(300)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(150, 260))) for _ in range(12)]
    texts += [t.upper() for t in texts[:3]] + [t + " #" for t in texts[:2]] + ["", None, " ", "A", "A", "|", "é\x0bÉ"]
    # long texts that part only in a late block, and those of one length that share their first blocks
    long = "word " * 60_000
    texts += [long, long, long[:-2] + "x ", long[:200_000] + "y" + long[200_001:]]
    rows = [(i, random.choice(texts), random.choice(["x", "y", None, ""]), "p", 1, 2, 3, 4, "q") for i in range(150)]
    rows += [(3, texts[0], "x", *rows[0][3:]), (3, texts[0], "x", *rows[0][3:]), (None, texts[0], "x", *rows[0][3:])]
    rows += [(1000 + i, long[:-1] + c, "z", *rows[0][3:]) for i, c in enumerate("abcdeabc")]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, random.choice((0, 1, None)), random.choice((0, 1, None))) for i in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = audited(d.select("doc_id", "text", "source"), labels).select(",".join(AUDIT)).fetchall()
    got = filter_audit.audit_filters(d, labels)
    assert got.columns == AUDIT
    same(map(tuple, got.collect()), map(tuple, want))
    monkeypatch.setattr(filter_audit, "BLOCK", 2)
    monkeypatch.setattr(filter_audit, "GROWTH", 2)
    monkeypatch.setattr(filter_audit, "BLOCKS", 4)  # the rest is left to the comparison of texts
    same(map(tuple, filter_audit.audit_filters(d, labels).collect()), map(tuple, want))


def test_filter_audit_by_hand(spark):
    """Three documents: a copy without other faults, its original, and one that fails C and D too."""
    good = " ".join(f"w{i}" for i in range(200))
    rows = [(1, good), (2, good), (3, "A$" + good)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_filters(d, labels).collect()}
    assert len(got) == 600
    assert got["ABCDE", 4] == (2, 1, 0, 1, 0, 1, 120) and got["ABCDE", 5] == (1, 1, 0, 1, 1, 0, 120) and got["ABCDE", 1] == (3, 0, 0, 0, 0, 0, 0)


def test_secrets_in_a_million_characters():
    """Runs without end, and much that only begins like a secret, take a time in proportion; the spans stay."""
    import re
    import time

    from swatchline.llm.secret_scan import Scanner

    scanner = Scanner()
    for text in ("x" * 1_000_000 + " a.", "A0" * 500_000 + ".", ("a" * 20 + ".") * 50_000, "eyJhbGciOiJ" * 90_000 + ".", "30" * 500_000, "-----BEGIN " * 90_000):
        began = time.time()
        scanner.spans(text)
        assert time.time() - began < 10
    plain = re.compile(r"[A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choice(["a" * random.randint(1, 16), ".", "..", " ", "-b_"]) for _ in range(random.randint(1, 14)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in scanner.token.finditer(text)]
    token = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode() + ".e30.c2ln"
    assert ("signed_token", 1_000_001, 1_000_001 + len(token)) in scanner.spans("x" * 1_000_000 + " " + token)


def test_top_k_of_large_values(spark):
    """Components of any finite size, beside Python's integers; columns of clashing names are not read."""
    from math import floor

    from swatchline.llm import impact_topk

    random.seed(8)
    sizes = (1.0, 1.0, 1.0, 1e6, 3e15, 1e18, 1e300)
    rows = [(i, [random.uniform(-1, 1) * random.choice(sizes) for _ in range(4)] if i % 3 == 0 else [random.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    rows += [(401, [1e308] * 4), (500, [-1e308, 1e308, 0.0, 5e-324]), (402, [float("inf")] * 4), (403, None), (404, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (600, [0.0] * 4)]
    df = spark.createDataFrame([(i, x, 1, "b", 2, 3) for i, x in rows], "vec_id long, embedding array<double>, id int, block string, v int, x int")
    whole = lambda x: (lambda n, d: n * 1024 // d)(*x.as_integer_ratio())
    known = [(i, [whole(c) for c in x]) for i, x in rows if i is not None and x and all(c is not None and abs(c) != float("inf") for c in x)]
    assert all(floor(1024 * c) == whole(c) for _, x in rows[:9] for c in x)
    want = set()
    for q, w in known:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, v in known if i != q)[:10]
            want |= {(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in impact_topk.top_k(df).collect()} == want
