"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions. For every kind the matches and the gaps between them
come from the same pattern; running sums of their lengths give the places, in
code points. Kinds: e-mail addresses, IP addresses, card numbers (Luhn), phone
numbers; the method adds account numbers (``iban``, mod 97) and card numbers of 13
to 15 digits (``card_short``, Luhn, only with a context word nearby).

Patterns are written possessively and start at run boundaries where the plain
form would walk long runs again and again; matches are the same.

Defined results: NULL text counts as empty; it and a text without personal data
have no spans. NULL and repeated ids are rows of their own. An empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import whole_text

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> pattern; base kinds in the order they are listed in results. \G: right after the match before
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("card_short", "iban")
#: a text without this cannot match
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"}
#: words that make a kind likelier, looked for within REACH characters on either side
CONTEXT = {
    "email": ("mail", "contact", "write to"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"), "card_short": ("card", "visa", "credit", "payment"), "iban": ("iban", "account", "bank", "konto"),
}
REACH = 40
#: score of a pattern match, of a checksum that holds, and of a context word
SCORES = (0.4, 0.3, 0.3)
_CHECKED = ("card", "card_short", "iban")
_BLOCK = 256


def _sums(numbers: Column) -> Column:
    """Running sums of a short array, starting with 0."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def proposals(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add a column ``m_<kind>`` with all leftmost matches: array of (hit, start, end).

    One step to a select: what several places use is a column of its own, which
    Spark does not evaluate again for each of them. Running sums are made in
    blocks, so that a text with very many matches stays near linear.
    """
    kept, kinds, t = rows.columns, list(PATTERNS), F.col(text)
    none = lambda of: F.array().cast(f"array<{of}>")

    def some(kind: str, value: Column, of: str) -> Column:
        return F.when(F.size(f"_hits_{kind}") > 0, value).otherwise(none(of))

    def hits(kind: str) -> Column:
        return F.when(t.rlike(_NEEDS[kind]), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none("string"))

    def steps(kind: str) -> Column:
        gaps = F.slice(F.split(t, PATTERNS[kind], -1), F.lit(1), F.size(f"_hits_{kind}"))
        return some(kind, F.zip_with(gaps, F.col(f"_hits_{kind}"), lambda g, h: F.length(g) + F.length(h)), "int")

    def blocks(kind: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(f"_steps_{kind}") - 1) / _BLOCK).cast("int"))
        of = lambda b: F.slice(_sums(F.slice(f"_steps_{kind}", b * _BLOCK + 1, F.lit(_BLOCK))), F.lit(2), F.lit(_BLOCK))
        return some(kind, F.transform(numbers, of), "array<int>")

    def ends(kind: str) -> Column:
        before = _sums(F.transform(f"_blocks_{kind}", lambda p: F.element_at(p, -1)))
        inside = F.zip_with(f"_blocks_{kind}", F.slice(before, F.lit(1), F.size(f"_blocks_{kind}")), lambda p, o: F.transform(p, lambda e: e + o))
        return some(kind, F.flatten(inside), "int")

    def found(kind: str) -> Column:
        return F.zip_with(f"_hits_{kind}", f"_ends_{kind}", lambda h, e: F.struct(h.alias("hit"), (e - F.length(h)).alias("start"), e.alias("end")))

    out = rows
    for name, value in (("_hits", hits), ("_steps", steps), ("_blocks", blocks), ("_ends", ends), ("m", found)):
        out = out.select("*", *[value(k).alias(f"{name}_{k}") for k in kinds])
    return out.select(*kept, *[f"m_{k}" for k in kinds])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod_97(hit: Column) -> Column:
    turned = F.concat(F.substr(hit, F.lit(5)), F.substr(hit, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _near(text: Column, kind: str, span: Column) -> Column:
    """A context word stands nearby."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    window = F.lower(F.substr(text, begin + 1, span["end"] - begin + REACH))
    found = F.lit(False)
    for w in CONTEXT[kind]:
        found = found | window.contains(w)
    return found


def _valid(text: Column, kind: str, m: Column) -> Column:
    digits = _digits(m["hit"])
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m["hit"].rlike(r"^(0*(\d{1,2}|1\d\d|2[0-4]\d|25[0-5])(\.|$)){4}$")
    if kind == "card":
        return n.between(16, 19) & luhn(digits)
    if kind == "card_short":
        return n.between(13, 15) & luhn(digits) & _near(text, kind, m)
    if kind == "phone":
        return n.between(8, 15)
    return mod_97(m["hit"])


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document a column for each kind: array of (start, end, score); on request the text it was found in (``_text``)."""
    base = docs.select("doc_id", whole_text("text").alias("text"))
    proposed = proposals(base)
    text = F.col("text")

    def confirmed(kind: str) -> Column:
        source = F.col("m_card" if kind == "card_short" else f"m_{kind}")
        pattern, check, context = SCORES
        score = lambda m: F.lit(pattern + (check if kind in _CHECKED else 0)) + F.when(_near(text, kind, m), context).otherwise(0.0)
        kept = F.filter(source, lambda m: _valid(text, kind, m))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), score(m).alias("score"))).alias(kind)

    return proposed.select("doc_id", *[confirmed(k) for k in (*BASE, *ADDED)], *([text.alias("_text")] if with_text else []))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the kinds in their order, comma-joined."""
    def each(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[each(k) for k in kinds]), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    return find(docs).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"), listed((*BASE, *ADDED)).alias("spans"),
    )


def masked(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``doc_id`` and the text with every span of at least the score replaced by its kind in brackets."""
    def of_kind(kind: str) -> Column:
        likely = F.filter(kind, lambda s: s["score"] >= least)
        return F.transform(likely, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = find(docs, with_text=True)
    all_spans = F.flatten(F.array(*[of_kind(k) for k in (*BASE, *ADDED)]))
    cut = F.aggregate(
        F.array_sort(F.col("_spans")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
        )),
        lambda a: F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1)),
    )
    return spans.withColumn("_spans", all_spans).select("doc_id", cut.alias("text"))
