"""Secrets in text: fixed patterns, and a battery of randomness tests on other tokens.

Tokens of ``LENGTHS[0]`` characters or more of an encoding (digits, hexadecimal, letters of one case,
base 32, base 64, letters and digits) are
tested against ordinary text of the same length: chi-squared uniformity over the
alphabet, runs of character classes, and serial correlation. Runs of letters of one case are
those of vowels and consonants, which words change between more often than chance; digits alone have no classes,
so the other two tests decide. Their three scores
are summed to one p-value (Stouffer), so one that speaks for ordinary text
outweighs another. How many tokens may be reported is controlled by false-discovery control over the whole
table, separately for each class of lengths, since a short token can hardly be
told from a word. The counts by p-value have a fixed size, whatever the corpus.

Defined results: NULL text counts as empty and has no spans. NULL and repeated
ids are rows of their own. An empty table gives an empty result. Extra columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import materialize

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: alphabet and its size, most special first
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"), ("base32", re.compile(r"[A-Z2-7]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: tokens of one class of characters, looked at before the others
ONE_CLASS = (
    ("digits", re.compile(r"[0-9]+"), "0123456789"), ("lower", re.compile(r"[a-z]+"), "abcdefghijklmnopqrstuvwxyz"),
    ("upper", re.compile(r"[A-Z]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
#: chance that two letters of ordinary text are equal; for hexadecimal and digits twice that of even digits
COINCIDENCE = {"hex": 2 / 16, "digits": 2 / 10}
TEXT_COINCIDENCE = 0.0667
#: ordinary text changes between small and capital letters and digits with at most this chance
CHANGES = 0.25
#: and between vowels and consonants with at least this one
VOWEL_CHANGES = 0.6
#: neighbours in counters, dates and words are correlated at least so much, either way
CORRELATION = 0.5
#: lower ends of the length classes
LENGTHS = (20, 24, 32, 48, 64)
#: expected share of false ones among the reported tokens of a length class
FALSE_SHARE = 0.01
_STEPS, _MOST = 20, 20


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _runs(name: str, body: str) -> float | None:
    """Deviation of the runs from those of ordinary text; less is more random."""
    if name == "digits":
        return None
    letters = name in ("lower", "upper")
    kinds = [c in "aeiouyAEIOUY" for c in body] if letters else [_kind(c) for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    mean = (len(body) - 1) * (VOWEL_CHANGES if letters else CHANGES)
    spread = math.sqrt(mean * (1 - (VOWEL_CHANGES if letters else CHANGES)))
    # random tokens change less often between vowels and consonants than words, and more often between other classes
    return (changes - mean) / spread if letters else (mean - changes) / spread


def p_value(token: str) -> float:
    """Chance that ordinary text of this length looks so random, from the tests that apply (Stouffer's sum)."""
    body = token.rstrip("=")
    name, _, alphabet = next(e for e in (*ONE_CLASS, *ENCODINGS) if e[1].fullmatch(token))
    if name == "hex":
        body = body.lower()
    n, size = len(body), len(alphabet)
    if n < LENGTHS[0]:
        return 1.0
    chi = sum(k * k for k in Counter(body).values()) * size / n - n
    excess = n * (size * COINCIDENCE.get(name, TEXT_COINCIDENCE) - 1)
    uniform = (chi - (size - 1) - excess) / math.sqrt(2 * (size - 1) + 4 * excess)
    runs = _runs(name, body)
    at = [alphabet.index(c) for c in body]
    middle = sum(at) / n
    spread = sum((x - middle) ** 2 for x in at)
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:], strict=False)) / spread if spread else 1.0
    correlated = (abs(serial) - CORRELATION) * math.sqrt(n)
    tests = [uniform, correlated] if runs is None else [uniform, runs, correlated]
    return _normal(sum(tests) / math.sqrt(len(tests)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def _scan(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and the tested tokens that no base span touches."""
    base = base_spans(text)
    tested = []
    at = reach = 0  # base spans that begin before the token's end, and how far they go
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and (p := p_value(m[0])) < 1:
            n = m.end() - m.start()
            tested.append({"start": m.start(), "end": m.end(), "lengths": sum(n >= x for x in LENGTHS), "step": min(_MOST * _STEPS, int(-math.log10(max(p, 1e-300)) * _STEPS))})
    return [{"start": a, "end": b, "kind": k} for a, b, k in base], tested


def scan(docs: DataFrame) -> DataFrame:
    """Per document its base spans and the tested tokens with the step of their p-value."""
    base = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    tested = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "lengths", "step")]))
    arrow_base = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    arrow_tested = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "lengths", "step")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scan(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], arrow_base), pa.array([f[1] for f in found], arrow_tested),
            ], names=["doc_id", "base", "tested"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("base", base), T.StructField("tested", tested)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut_steps(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Per class of lengths the least step that is reported (Benjamini and Hochberg), from a table of fixed size."""
    counts = scanned.select(F.explode("tested").alias("t")).groupBy("t.lengths", "t.step").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts: dict[int, int] = {}
    for lengths in {c["lengths"] for c in counts}:
        own = sorted(((c["step"], c["n"]) for c in counts if c["lengths"] == lengths), reverse=True)
        total, rank = sum(n for _, n in own), 0
        for step, n in own:
            rank += n
            # the whole step counts with its largest p-value
            if 10 ** (-step / _STEPS) * total <= share * rank:
                cuts[lengths] = step
    return cuts


def report(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans by start and kind."""
    scanned = materialize(scan(docs))
    cuts = cut_steps(scanned, share)

    def passes(t: Column) -> Column:
        out = F.lit(False)
        for lengths, step in cuts.items():
            out = out | ((t["lengths"] == lengths) & (t["step"] >= step))
        return out

    added = F.transform(F.filter("tested", passes), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*BASE, "random")]), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.transform(F.concat("base", added), order))).alias("spans"),
    )
