"""Exact and near duplicates, repeated lines, fuse filters, components."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.brute import near_components
from tests.llm.conftest import PROSE, ROWS, rows
from tidemark.llm import exact_dedup, fuse, lines, near_dedup
from tidemark.llm.components import components


def brute_exact(table):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in table:
        group = [(-len(u or ""), j is None, j or 0) for j, u in table if bare(u) == bare(t)]
        best = min(group)
        out.append((i, None if best[1] else best[2], len(group), hashlib.sha256(bare(t).encode()).hexdigest()))
    return out


def test_exact_matches_plain_version(odd_docs):
    got = exact_dedup.deduplicate(odd_docs, bucket_rows=4)
    assert rows(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(brute_exact([r[:2] for r in ROWS]), key=repr)
    kept = got.where("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == got.select("text_sha256").distinct().count()


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_does_not_depend_on_batches(docs, batches):
    assert rows(exact_dedup.deduplicate(docs, batches)) == rows(exact_dedup.deduplicate(docs, 2))


def test_exact_keeps_whole_rows_and_one_of_repeated_rows(odd_docs, no_docs):
    out = exact_dedup.kept_documents(odd_docs, exact_dedup.deduplicate(odd_docs))
    assert out.columns == odd_docs.columns
    texts = [re.sub(r"\s", "", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r[1] or "") for r in ROWS})
    assert exact_dedup.deduplicate(no_docs).count() == 0


def test_other_bytes_under_one_digest_stay_apart(spark, monkeypatch):
    """With a screen that lets everything through and bytes that never agree nothing of a snapshot is matched."""
    df = spark.createDataFrame([(i, "same") for i in range(8)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "same_bytes", lambda pairs, docs: pairs.select("text_sha256").limit(0))
    out = exact_dedup.deduplicate(df).collect()
    assert len({r["keep_id"] for r in out}) == 2 and sum(r["kept"] for r in out) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_fuse_filter_holds_its_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    f = fuse.build(keys)
    assert f.contains(keys).all()
    others = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    assert f.contains(others).mean() < 0.01
    assert len(f.slots) < 1.4 * n + 300


def test_near_matches_plain_version(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        table = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert rows(near_dedup.near_duplicates(df)) == sorted(near_components(table), key=repr)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_group_of_copies_around_an_original(spark):
    """Copies that differ from each other more than from their original, some beyond the limit; and chains."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(160)]
    table = [(0, " ".join(base))]
    for i in range(1, 120):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        table.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(260)]
    table += [(1000 + k, " ".join(chain[4 * k: 4 * k + 120])) for k in range(20)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(df)) == sorted(near_components(table), key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200}


def test_lines_are_removed_but_for_the_first(spark, odd_docs, no_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    table = [(1, f"start\n{passage}\nend"), (2, f"{passage.upper()}  \nother"), (3, "x\n\n" + passage.replace(" ", "  ")), (4, "short line\nshort line"), (None, passage), (5, None), (6, "")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    removed = lines.repeated(df)
    got = {r["doc_id"]: r for r in removed.collect()}
    assert set(got) == {2, 3, None} and all(r["keep_doc_id"] == 1 and r["keep_start"] == 6 for r in got.values())
    texts = {r["doc_id"]: r for r in lines.cleaned(df, removed).collect()}
    assert texts[2]["text"] == "other" and texts[3]["text"] == "x\n\n" and texts[None]["text"] == "" and texts[1]["text"] == table[0][1]
    original = dict(table)
    for i, r in texts.items():
        assert (r["text"] or "") == "".join((original[i] or "")[s["start"]: s["end"]] for s in r["kept_spans"] or [])
    assert [(r["doc_id"], r["keep_doc_id"]) for r in lines.repeated(odd_docs).collect() if r["doc_id"] == 13] == [(13, 11), (13, 11)]
    assert lines.repeated(no_docs).count() == 0


def test_paragraphs():
    text = "\n".join(f"a{i} b" for i in range(15)) + "\n \n" + PROSE
    found = list(lines.units(text, "paragraph"))
    assert len(found) == 2 and text[found[0][1]: found[0][2]].endswith("a14 b") and text[found[1][1]:] == PROSE
