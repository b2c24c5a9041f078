"""Results come through the methods named, and rows that share an id keep apart."""

import random
import string
import time

from tests.llm.conftest import rows
from tidemark.llm import exact_dedup, pii, secret_scan


def test_what_the_filters_deny_is_new(spark, docs, monkeypatch):
    """With a screen that always says no, copies in different batches stay apart; within a batch they meet."""
    table = [(i, f"text {i % 20}") for i in range(200)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    together = exact_dedup.deduplicate(df)
    assert {r["group_size"] for r in together.collect()} == {10} and together.where("kept").count() == 20
    monkeypatch.setattr(exact_dedup, "screen", lambda groups, snapshot: groups.select("text_sha256").limit(0))
    apart = exact_dedup.deduplicate(df).collect()
    assert all(r["group_size"] < 10 for r in apart) and sum(r["kept"] for r in apart) == 40
    for r in apart:
        assert r["keep_id"] % 20 == r["doc_id"] % 20


def test_bytes_decide_among_positives(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 20}") for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "same_bytes", lambda pairs, docs: pairs.select("text_sha256").limit(0))
    assert exact_dedup.deduplicate(df).where("kept").count() == 40


def test_masked_rows_keep_apart(spark):
    table = [(1, "mail a.b@example.org now"), (None, "call +41 44 123 45 67 or x@y.zz"), (2, "mine: c@d.ee"), (2, "nothing here"), (None, None)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(pii.masked(df)) == sorted([
        (1, "mail [email] now"), (None, "call [phone] or [email]"), (2, "mine: [email]"), (2, "nothing here"), (None, ""),
    ], key=repr)


def test_random_tokens_of_one_class(spark):
    """Planted tokens in prose of words as long; the figures are printed."""
    rng = random.Random(8)
    kinds = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "mixed": string.ascii_letters + string.digits}
    planted = [(k, "".join(rng.choice(a) for _ in range(48))) for k, a in kinds.items() for _ in range(50)]
    syllables = [c + v + e for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r", "s")]
    words = ["".join(rng.choice(syllables) for _ in range(9)) for _ in range(400)] + [f"{i:022d}" for i in range(50)]
    table = [(i, f"see {t} there") for i, (_, t) in enumerate(planted)] + [(1000 + i, f"the word {w} here") for i, w in enumerate(words)]
    found = {r["doc_id"] for r in secret_scan.report(spark.createDataFrame(table, "doc_id long, text string")).where("spans like '%random:%'").collect()}
    recall = {k: sum(i in found for i, (kind, _) in enumerate(planted) if kind == k) for k in kinds}
    false = len([i for i in found if i >= 1000])
    print(f"found of 50 each: {recall}; ordinary tokens reported: {false} of {len(words)}")
    assert recall["mixed"] >= 48 and recall["lower"] >= 40 and recall["upper"] >= 40
    assert false <= 0.03 * max(1, len(found))


def test_many_spans_take_linear_time():
    def seconds(n):
        text = " ".join(f"token={i:08d} {'ab12' * 6} {'Zx9' * 8}" for i in range(n))
        began = time.perf_counter()
        base, _ = secret_scan._scan(text)
        assert len(base) >= n
        return time.perf_counter() - began

    seconds(200)
    assert seconds(8000) < 12 * seconds(1600)


def test_tokens_that_touch_a_base_span_are_not_tested():
    rng = random.Random(1)
    token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    base, tested = secret_scan._scan(f"{token} password={token} {token}")
    assert [(b["start"], b["kind"]) for b in base] == [(41, "assign")] and [t["start"] for t in tested] == [0, 91]
