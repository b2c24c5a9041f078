"""Mixing, tokens, packing, archives, search."""

import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import rows
from tidemark.llm import knn, mixing, packing, warc
from tidemark.llm.tokens import Tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_targets_fill_up_to_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), ("d", 30), (None, 60), ("e", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 400, "d": 30, "e": 0, None: 60}, dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    # the rule itself, round by round
    want, total, clamped = {}, 1.5 * 1500, set()
    while True:
        rest = total - sum(2 * size[s] for s in clamped)
        open_weight = sum(weight[s] for s in size if s not in clamped)
        want = {s: 2.0 * size[s] if s in clamped else rest * weight[s] / open_weight for s in size}
        over = {s for s in size if s not in clamped and want[s] > 2 * size[s]}
        if not over:
            break
        clamped |= over
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets_and_repeatable(docs, odd_docs, no_docs):
    first, again = mixing.mix(docs).collect(), mixing.mix(docs).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    for s in {r["source"] for r in first}:
        own = [r for r in first if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count() and out.where("size = 0 and taken <> 0").count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = lambda df: df.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")))).first()[0]
    assert words(mixed.where("source = 'c'")) == out.where("source = 'c'").agg(F.sum("taken")).first()[0]
    assert mixing.mix(no_docs).count() == mixing.mixed_documents(no_docs).count() == 0


def test_tokens_are_those_of_the_library():
    rng = random.Random(5)
    alphabet = [" ", "\n", "a", "B", "1", ".", "'s", "\t", "é", " ", "　", "😀", "\x1f", "\r", "\x0b", "<|endoftext|>", " ", "x́"]
    texts = ["", None, "w" * 3000, *["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(3000)]]
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    ours = Tokens(FILE)
    assert ours.fast
    for tokens in (ours, ours):  # new words, and remembered ones
        got = [ids.tolist() for rows_, flat, ends in tokens.encode(pa.array(texts)) for ids in np.split(flat, ends[:-1])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    ours.fast = None
    ours._forget()
    assert [flat.tolist() for _, flat, _ in ours.encode(pa.array(["some slow words"]))] == [plain.encode("some slow words", add_special_tokens=False).ids]


def check_packed(packed, capacity):
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(docs, odd_docs, no_docs):
    for df, capacity in ((docs, 2048), (odd_docs, 64)):
        out = packing.pack_documents(df, FILE, capacity, with_ids=True)
        packed = out.collect()
        count = check_packed(packed, capacity)
        assert count <= 1.02 * sum(r["length"] for r in packed) / capacity + 1
        plain = Tokenizer.from_file(FILE)
        want = sorted(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in df.collect())
        whole, current = [], None
        for r in sorted(packed, key=lambda r: (repr(r["doc_id"]), r["piece"])):
            assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
            if r["doc_id"] is not None and r["doc_id"] != 1:
                whole.append((r["doc_id"], r["start"], r["ids"]))
        by_doc = {}
        for doc, start, ids in whole:
            assert start == len(by_doc.setdefault(doc, []))
            by_doc[doc] += ids
        assert all(v in want for v in by_doc.values()) and current is None
        held = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(out).collect()}
        assert sum(held.values()) == sum(r["length"] for r in packed)
    assert packing.pack_documents(no_docs, FILE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.uniform(1, 6), 1)))) for _ in range(rng.choice([1, 50, 3000]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    out, large = [], {}
    for r in packing.plan(histogram, capacity):
        for turn in range(r.lo, r.hi):
            at, k = divmod(turn - r.lo, r.each)
            out.append({"sequence_id": r.first + at, "offset": r.offset + k * r.length, "length": r.length, "turn": turn})
            if 3 * r.length > capacity:
                large[r.first + at] = large.get(r.first + at, 0) + 1
    assert sorted((o["length"], o["turn"]) for o in out) == sorted((n, t) for n, c in histogram.items() for t in range(c))
    assert not large or max(large.values()) <= 2
    assert check_packed(out, capacity) <= 1.25 * sum(lengths) / capacity + 1


def test_zip_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"abc" * 10)
        for i in range(70_000):  # more than the 16-bit count holds
            z.writestr(f"m/{i}", str(i))
        z.comment = b"a comment"
    data = raw.getvalue()
    found = {m.name: m for m in warc.members(lambda a, n: data[a: a + n], len(data))}
    assert len(found) == 70_001
    for name, want in (("wide", b"abc" * 10), ("m/69999", b"69999"), ("m/0", b"0")):
        assert data[found[name].start: found[name].start + found[name].size] == want
    with pytest.raises(ValueError):
        warc.members(lambda a, n: b"x" * n, 40)


def test_archives_round_trip(spark, tmp_path):
    table = [(3, "http://a/\r\nx", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", "same"), (2, "u", "same"), (5, "v", "same"), (6, "w", None), (7, "w", ""), (None, "z", "lone"), (8, "y", "k" * 300_000)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    written = warc.write(pages, str(tmp_path / "a"), zip_bytes=1000)
    back = warc.read(written, str(tmp_path / "a"), with_payload=True, block_bytes=500).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back), key=repr)
    assert got == sorted([(3, "revisit", 1, 9), (1, "response", None, 9), (2, "response", None, 4), (2, "response", None, 4), (5, "revisit", 2, 4),
                          (6, "response", None, 0), (7, "revisit", 6, 0), (None, "response", None, 4), (8, "response", None, 300_000)], key=repr)
    assert {r["page_id"]: r["payload"].decode() for r in back if r["record_type"] == "response"}[8] == "k" * 300_000
    assert all(r["payload_digest"] == warc.payload_digest(r["payload"]) for r in back if r["payload"] is not None)
    some = warc.read(warc.write(pages, str(tmp_path / "b"), least_bytes=5), str(tmp_path / "b"))
    assert {r["page_id"] for r in some.where("record_type = 'revisit'").collect()} == {3}
    assert warc.round_trip(pages.limit(0)).count() == 0


def brute_top_k(table, k=5):
    scaled = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    unique = sorted({(i, tuple(v)) for i, v in scaled})
    out = []
    for q, v in unique:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in unique if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_matches_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(1)
    table = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(400)]
    table += [(400 + i, [1.0] * 8) for i in range(200)]  # one vector many times: ties
    table += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (None, [1.0] * 8), (3, table[3][1]), (1150, [2.0, 3.0]), (1200, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    table = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_top_k(table)
    condition = F.col("vec_id") % 50 == 0
    assert rows(knn.search(df, condition)) == sorted(want, key=repr)
    monkeypatch.setattr(knn, "DATA_CHUNK", 50)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    assert rows(knn.search(df, condition)) == sorted(want, key=repr)
    few = df.where("vec_id in (0, 1, 2)")
    assert rows(knn.search(few, condition)) == sorted(brute_top_k([t for t in table if t[0] in (0, 1, 2)]), key=repr)
    assert knn.search(df.limit(0), condition).count() == 0


def test_search_with_components_beyond_doubles(spark):
    table = [(i, [float(3 + i) * 1e12, 1.0]) for i in (0, 1, 2, 50)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    assert [r for r in rows(knn.search(df, F.col("vec_id") % 50 == 0, 2)) if r[0] == 0] == [(0, 1, 1, top), (0, 2, 2, top)]
