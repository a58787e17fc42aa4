"""Secret scans: patterns find candidates, and structure confirms them.

Base kinds are patterns alone. The method decodes every run of base64, base64url and hex characters that could hold a
key, at each of its alignments and also where the run goes on over line ends (real ones, or written as \\n), and reports
what parses at any place in it: DER private keys (PKCS 1 and 8, plain and encrypted, SEC 1, DSA, PKCS 12), whose nested
lengths fit exactly, and OpenSSH private keys, whose length-prefixed strings do. PEM blocks of private keys are reported
if their body parses so, or is encrypted as its header lines say. Signed tokens are reported if their header is a JSON
object with an algorithm. Public keys, certificates and signatures parse too but are no secrets, and aren't reported.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import small_batches, table

#: The base patterns; a match of fewer than the least characters is no hit.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ["assign", "access", "hex", "pem", "private_key", "ssh_key", "signed_token"]
BASE_KINDS = KINDS[:3]
#: Characters of base64 that the smallest private key needs at least, and of a run that may be part of it.
SMALLEST, RUN = 54, 20
SSH_MAGIC = b"openssh-key-v1\0"
#: Prefixes of the object identifiers of password-based encryption (PKCS 5 and 12) and of PKCS 7.
ENCRYPTIONS, CONTENTS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")), bytes.fromhex("2a864886f70d0107")


def der_value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER value at a place, by its shortest length form; None if none fits before end."""
    if at + 2 > end:
        return None
    tag, length = data[at], data[at + 1]
    at += 2
    if tag & 0x1F == 0x1F or tag == 0:
        return None
    if length & 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        length = int.from_bytes(data[at : at + size], "big")
        at += size
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def der_values(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill data from at to end exactly; None if they don't."""
    out = []
    while at < end:
        if (value := der_value(data, at, end)) is None:
            return None
        out.append(value)
        at = value[2]
    return out


def der_fits(data: bytes, at: int, end: int) -> bool:
    """Whether data from at to end is values whose nested lengths fit, to any depth."""
    todo = [(at, end)]
    while todo:
        if (found := der_values(data, *todo.pop())) is None:
            return False
        todo += [(a, b) for tag, a, b in found if tag & 0x20]
    return True


def private_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the DER private key that begins at a place ends; None if none does."""
    top = der_value(data, at, len(data))
    if top is None or top[0] != 0x30 or not (parts := der_values(data, top[1], top[2])):
        return None
    tags = [t for t, _, _ in parts]
    value = [data[a:b] for _, a, b in parts]
    inner = lambda i: der_values(data, *parts[i][1:]) or [(0, 0, 0)]
    named = lambda i, names: inner(i)[0][0] == 0x06 and data[inner(i)[0][1] : inner(i)[0][2]].startswith(names)
    numbers = set(tags) == {0x02}
    found = (
        (tags[:3] == [0x02, 0x30, 0x04] and value[0] in (b"\0", b"\1") and inner(1)[0][0] == 0x06)  # PKCS 8
        or (numbers and len(tags) >= 9 and value[0] in (b"\0", b"\1"))  # PKCS 1
        or (numbers and len(tags) == 6 and value[0] == b"\0")  # DSA
        or (tags[:2] == [0x02, 0x04] and value[0] == b"\1" and 16 <= len(value[1]) <= 80)  # SEC 1
        or (tags == [0x30, 0x04] and named(0, ENCRYPTIONS) and len(value[1]) % 8 == 0 < len(value[1]))  # encrypted PKCS 8
        or (tags[:2] == [0x02, 0x30] and value[0] == b"\3" and named(1, CONTENTS))  # PKCS 12
    )
    return top[2] if found and all(value[i] for i, t in enumerate(tags) if t == 0x02) and der_fits(data, top[1], top[2]) else None


def ssh_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH private key that begins at a place ends: three strings, a count, as many public keys, and one string."""
    if not data.startswith(SSH_MAGIC, at):
        return None
    at += len(SSH_MAGIC)
    left, keys = 3, None
    while left:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        left -= 1
        if at > len(data):
            return None
        if not left and keys is None:
            keys = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
            if not keys:
                return None
            at, left = at + 4, keys + 1
    return at


def _base64(text: str) -> bytes:
    """The whole bytes that base64 or base64url characters give, without padding."""
    whole = len(text) * 3 // 4
    return base64.b64decode(text.replace("-", "+").replace("_", "/") + "A" * (-len(text) % 4))[:whole]


def header_fits(text: str, at: int = 0) -> bool:
    """Whether the text from a place on is a JSON object with an algorithm, as a signed token's header is.

    The first characters are tried by themselves, so that what is wrong there isn't told from the whole text.
    """
    for end in (at + 4096, len(text)):
        part = text[at:end]
        try:
            head, stop = json.JSONDecoder().raw_decode(part)
        except RecursionError:
            return False
        except json.JSONDecodeError as e:
            if end >= len(text) or e.pos < len(part) - 1 and not e.msg.startswith("Unterminated"):
                return False
            continue
        return isinstance(head, dict) and isinstance(head.get("alg"), str) and re.compile(r"\s*").match(text, at + stop).end() == len(text)
    return False


class Scanner:
    def __init__(self):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
        self.marks = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
        self.escaped = re.compile(r"\\r\\n|\\[nr]")
        self.body = re.compile(r"[A-Za-z0-9+/\s]*={0,2}\s*")
        # begun at the first character of a run alone, and without giving any back: a run is read once
        self.token = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{14,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
        self.opening = re.compile(r"(?=e[w-z0-9_-]|[ICD])")  # how a brace, or a blank before it, begins in base64
        self.brace = re.compile(r'[ \t\r\n]{0,8}\{(?=\s*"[^"\\]*"\s*:)')
        self.run = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % RUN)
        self.more = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
        self.padding = re.compile(r"={0,2}")
        self.hex_run = re.compile(r"[0-9A-Fa-f]{%d,}" % (SMALLEST * 3 // 2))
        # a sequence of some length, in which a small number or a named sequence comes first
        self.key = re.compile(rb"(?=\x30(?:[\x20-\x7f]|\x81[\x80-\xff]|\x82[\x01-\xff][\x00-\xff]|\x83[\x01-\xff][\x00-\xff]{2}|\x84[\x01-\xff][\x00-\xff]{3})(?:\x02\x01[\x00\x01\x03]|\x30[\x00-\xff]{1,5}\x06)|openssh-key-v1\x00)", re.DOTALL)

    def base(self, text: str) -> list[tuple[str, int, int]]:
        out = [("assign", *m.span()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        # the runs of 24 and more are just the long ones among all maximal runs
        return out + [("hex", *m.span()) for m in self.hex.finditer(text)]

    def keys(self, data: bytes, step: int) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the private keys in data that begin at multiples of step; none within another."""
        out, last = [], 0
        for m in self.key.finditer(data):
            at = m.start()
            if at >= last and at % step == 0:
                ssh = data[at] != 0x30
                if (end := ssh_key_end(data, at) if ssh else private_key_end(data, at)) is not None:
                    out.append(("ssh_key" if ssh else "private_key", at, end))
                    last = end
        return out

    def pems(self, text: str, plain: str) -> list[tuple[str, int, int]]:
        out, opened = [], None
        for m in self.marks.finditer(plain):
            if m[1] == "BEGIN":
                opened = m
            elif opened and opened[2] == m[2]:
                lines = plain[opened.end() : m.start()].strip().splitlines()
                heads = [x for x in lines if ":" in x]
                body = "\n".join(x for x in lines if ":" not in x)
                data = _base64("".join(body.split()).rstrip("=")) if self.body.fullmatch(body) else b""
                locked = any("ENCRYPTED" in x for x in heads) and any(x.strip().startswith("DEK-Info:") for x in heads) and len(data) % 8 == 0
                if data and (locked or private_key_end(data) == len(data) or ssh_key_end(data) == len(data)):
                    out.append(("pem", opened.start(), m.end()))
                opened = None
        return out

    def tokens(self, text: str) -> list[tuple[str, int, int]]:
        """The header may begin anywhere in its run: what stands before the key in the same characters isn't part of it."""
        out = []
        for m in self.token.finditer(text):
            head = m[0].split(".", 1)[0]
            decoded = [_base64(head[k:]).decode("latin-1") for k in range(4)]
            for at in (x.start() for x in self.opening.finditer(head)):
                brace = self.brace.match(decoded[at % 4], at // 4 * 3)
                if brace and (len(head) - at) % 4 != 1 and header_fits(decoded[at % 4], brace.end() - 1):
                    out.append(("signed_token", m.start() + at, m.end()))
                    break
        return out

    def runs(self, plain: str):
        """(characters, their places) of runs, joined over line ends."""
        at = 0
        while m := self.run.search(plain, at):
            parts, at = [m.span()], m.end()
            while more := self.more.match(plain, at):
                parts.append(more.span(1))
                at = more.end()
            if sum(b - a for a, b in parts) >= SMALLEST:
                yield "".join(plain[a:b] for a, b in parts), parts

    def structural(self, text: str) -> list[tuple[str, int, int]]:
        plain = self.escaped.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text) if "\\" in text else text
        out = self.pems(text, plain) if "-----BEGIN " in text else []
        if "." in text:
            out += self.tokens(text)
        found = set()
        for chars, parts in self.runs(plain):
            ends = list(itertools.accumulate(b - a for a, b in parts))

            def place(i):
                part = bisect.bisect_right(ends, i)
                return parts[part][0] + i - (ends[part - 1] if part else 0)

            for k in range(4):
                data = _base64(chars[k:])
                for kind, a, b in self.keys(data, 3):
                    end = place(k + -(-b * 4 // 3) - 1) + 1
                    found.add((kind, place(k + a // 3 * 4), self.padding.match(plain, end).end()))
        for m in self.hex_run.finditer(text):
            for k in range(2):
                half = m[0][k : k + (len(m[0]) - k) // 2 * 2]
                found |= {(kind, m.start() + k + 2 * a, m.start() + k + 2 * b) for kind, a, b in self.keys(bytes.fromhex(half), 1)}
        blocks = [(a, b) for kind, a, b in out if kind == "pem"]
        return out + [x for x in found if not any(a <= x[1] and x[2] <= b for a, b in blocks)]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind as listed."""
        return sorted(self.base(text) + self.structural(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    scanner = Scanner()
    for pdf in batches:
        out = []
        for i, text in zip(pdf["id"], pdf["text"], strict=True):
            spans = scanner.spans(text or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            out.append((i, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
        yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null text counts as empty.

    Rows stay apart whatever their ids. spans has kind:start:end, joined by commas; empty if nothing is found.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_scan, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumn("doc_id", F.col("doc_id").cast("long"))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each run of overlapping or touching spans replaced by mark."""
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + mark + text[b:]
    return text


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of the text column replaced by mark; null texts and other columns stay as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        scanner = Scanner()
        return pd.Series([redacted(t, scanner.spans(t), mark) if t else t for t in texts], dtype=object)

    return docs.withColumn(text_col, udf.asNondeterministic()(F.col(text_col)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
