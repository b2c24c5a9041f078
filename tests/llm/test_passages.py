import re
from collections import Counter, defaultdict

import pyarrow as pa

from tests.llm.conftest import PROSE, rows
from tidemark.llm import lines, passages
from tidemark.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(part):
    return tuple(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), part)))


def pieces(text, pattern, base=0):
    start = 0
    for m in [*re.finditer(pattern, text), None]:
        end = m.start() if m else len(text)
        if norm(text[start:end]):
            yield base + start, base + end, norm(text[start:end])
        start = m.end() if m else 0


def plain_units(text):
    """(kind, start, end, words, slot, slot_to) by loops."""
    out, slot = [], 0
    for start, end, words in pieces(text, "\n"):
        own = [(a, b, w) for a, b, w in pieces(text[start:end], "[.!?]", start) if len(w) >= 3]
        spans = [(slot + k, *s) for k, s in enumerate(own)]
        if len(words) >= 3:
            last = slot + max(len(own) - 1, 0)
            if sum(len(w) for _, _, w in own) < len(words):
                out.append((0, start, end, words, slot, last))
        out += [(1, a, b, w, k, k) for k, a, b, w in spans]
        slot += len(own) or (1 if len(words) >= 3 else 0)
    return out


def brute(table, stretch=25, gap=1):
    """(doc_id, unit, start, end, keep_doc_id, keep_start, occurrences, passage_words) for rows with ids of their own."""
    found = defaultdict(list)
    units = {i: plain_units(t or "") for i, t in table}
    for i, us in units.items():
        for u in us:
            found[u[0], u[3]].append((i is None, i or 0, u[1], i))
    first = {k: min(v, key=lambda r: r[:3]) for k, v in found.items()}
    out = []
    for i, us in units.items():
        repeats = [u for u in us if len(found[u[0], u[3]]) > 1 and first[u[0], u[3]][2:] != (u[1], i)]
        part, past, parts = 0, None, defaultdict(list)
        for u in sorted(repeats, key=lambda u: (u[4], -u[5], u[0])):
            if past is None or u[4] > past + 1 + gap:
                part += 1
            if past is None or u[5] > past:
                parts[part].append(u)
            past = max(u[5], past if past is not None else -1)
        for us_ in parts.values():
            total = sum(len(u[3]) for u in us_)
            if total >= stretch:
                out += [(i, "sentence" if u[0] else "line", u[1], u[2], first[u[0], u[3]][3], first[u[0], u[3]][2], len(found[u[0], u[3]]), total) for u in us_]
    return sorted(out, key=repr)


def test_units_and_their_slots():
    texts = ["", "one two three. Four five SIX!  seven\n\neight nine  ten? a", "no\nNO! NO! NO! NO!\nünï cödé wörds. 日本 a b\n", None, ". . .\n", "x y z", PROSE, "a b c.d e f\x0bg"]
    for _, data, offsets in X.chunks(pa.array(texts, pa.string())):
        got = passages._found(data, offsets)
        each = defaultdict(list)
        for t, *u in zip(got["text"], *(got[n] for n in ("kind", "start", "end", "words", "slot", "slot_to")), strict=True):
            each[t].append(tuple(int(x) for x in u))
        for t, text in enumerate(texts):
            assert sorted(each[t]) == sorted((k, a, b, len(w), s, e) for k, a, b, w, s, e in plain_units(text or "")), text
    digests = {(a, b) for a, b in zip(got["a"], got["b"], strict=True)}
    same = passages._found(*next(iter(X.chunks(pa.array(["X  y\tZ", "x y. z"]))))[1:])
    of = same["kind"].tolist().index(passages.SENTENCE)
    assert same["text"][of] == 0 and (same["a"][of], same["b"][of]) in digests


def test_repeats_of_all_documents(docs, odd_docs):
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = rows(passages.repeated(docs).drop("text_key", "keep_text_key"))
    assert got == brute(table) and len(got) > 20
    own = odd_docs.where("doc_id is not null and doc_id <> 1")
    assert rows(passages.repeated(own).drop("text_key", "keep_text_key")) == brute([(r["doc_id"], r["text"]) for r in own.collect()])


def test_passages_wherever_they_begin(spark, no_docs):
    passage = "This sentence has seven words in it. " + "; ".join(f"clause {i} of the second one" for i in range(6)) + ". And here the third one ends, after some words"
    table = [
        (1, f"before it {passage} and more. End"), (2, f"other words {passage.upper().replace(' ', '  ')} differ here.\nEnd"), (3, passage.replace(". ", ".\n")),
        (4, "And here the third one ends, after some words."), (5, "nothing of it at all"), (None, passage), (None, "x"), (6, None),
    ]
    df = spark.createDataFrame(table, "doc_id long, text string")
    removed = passages.repeated(df)
    assert {r["doc_id"] for r in removed.collect()} == {2, 3, None}
    assert rows(passages.repeated(df.where("doc_id is not null")).drop("text_key", "keep_text_key")) == brute(table[:5])
    assert {r["doc_id"] for r in passages.repeated(df, stretch=3).collect()} == {2, 3, 4, None}
    assert passages.repeated(no_docs).count() == 0
    out = {(r["doc_id"], len(r["text"] or "")): r for r in lines.cleaned(df, removed).collect()}
    assert len(out) == len(table) and (None, 1) in out and (5, 20) in out
    for r in out.values():
        original = next(t for i, t in table if i == r["doc_id"] and (t == "x") == (r["text"] == "x"))
        assert (r["text"] or "") == "".join((original or "")[s["start"]: s["end"]] for s in r["kept_spans"] or [])


def test_rows_that_share_an_id_keep_apart(spark):
    same = "a passage of some ten words that stands in several rows here and there, "
    table = [(None, "unique text that nobody else has"), (None, f"first part\n{same * 3}"), (None, f"second part\n{same * 3}"), (2, f"{same * 3}\nown end"), (2, "short"), (2, f"{same * 3}\nown end")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    for removed in (passages.repeated(df), lines.repeated(df)):
        out = sorted(r["text"] for r in lines.cleaned(df, removed).collect())
        assert out == sorted(["unique text that nobody else has", "first part\n", "second part\n", table[3][1], "short", table[3][1]])


def test_planted_passages_are_found_and_clean_texts_left(spark, sf):
    """Against word sequences: texts that hold 50 words of an earlier one, and those that share no 20 words with any."""
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    table, seen = [], set()
    for r in docs.orderBy("doc_id").collect():
        key = re.sub(r"\s", "", r["text"] or "")
        if key not in seen:
            seen.add(key)
            table.append((r["doc_id"], norm(r["text"] or "")))
    grams = lambda n: {i: {hash(w[k: k + n]) for k in range(len(w) - n + 1)} for i, w in table}
    long, short = grams(50), grams(20)
    first = {}
    for i, _ in table:
        for g in long[i]:
            first.setdefault(g, i)
    # words repeated one after the other are junk, no passage
    later = {i for i, w in table if any(first[g] < i for g in long[i]) and max(Counter(w).values()) < 0.2 * len(w)}
    count = Counter(g for s in short.values() for g in s)
    clean = {i for i, _ in table if all(count[g] == 1 for g in short[i])}
    only = spark.createDataFrame([(i,) for i, _ in table], "_id long")
    hit = {r["doc_id"] for r in passages.repeated(docs.join(only, docs["doc_id"] == only["_id"]).drop("_id")).select("doc_id").distinct().collect()}
    print(f"passages found in {len(hit & later)} of {len(later)} texts, clean texts touched: {len(hit & clean)} of {len(clean)}")
    assert len(later) > 20 and len(hit & later) >= 0.95 * len(later) and len(hit & clean) <= 0.04 * len(clean)
