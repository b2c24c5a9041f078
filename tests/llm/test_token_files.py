import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.functions.session import checkpoint_dir
from tidemark.llm import token_files as T

FILE = path("byte_bpe_50k.json")


def plain_rows(docs):
    """(doc_id, start, n_tokens, ids_crc32, ids) by a loop over the rows in order of their ids."""
    tokenizer = Tokenizer.from_file(FILE)
    out, start = [], 0
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("values", [[], [0], [0] * 9, [1], [50256, 0, 3], [2**32 - 1, 5], list(range(1000))])
def test_planes_round_trip(values, kind):
    ids = np.array(values, "<u4")
    planes = T.to_planes(ids, kind)
    assert len(planes) == -(-max([0, *values]).bit_length() // (1 if kind == "bit" else 8))
    assert T.from_planes(planes, len(ids), kind).tolist() == values


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_of_many_blocks(kind):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50257, 1003).astype("<u4")
    out = io.BytesIO()
    file = T.Writer(out, 64, kind)
    cuts = [0, 5, 6, 400, 401, 1003]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        file.add(pa.array([i if i != 2 else None], pa.int64()), np.array([b - a]), ids[a:b])
    file.close()
    assert file.at == len(out.getvalue())
    reader = T.Reader(pa.BufferReader(out.getvalue()))
    doc_ids, lengths = reader.documents()
    assert doc_ids.to_pylist() == [0, 1, None, 3, 4] and lengths.tolist() == np.diff(cuts).tolist()
    assert reader.counts.tolist() == [64] * 15 + [43]
    assert np.concatenate(list(reader.blocks())).tolist() == ids.tolist()
    for lo, n in ((0, 1), (63, 2), (64, 64), (1000, 50), (0, 1003), (1003, 1), (500, 0)):
        assert reader.read(lo, n).tolist() == ids[lo: lo + n].tolist()
    broken = bytearray(out.getvalue())
    broken[20] ^= 255
    with pytest.raises((ValueError, zstd_error())):
        list(T.Reader(pa.BufferReader(bytes(broken))).blocks())
    with pytest.raises(ValueError):
        T.Reader(pa.BufferReader(b"x" * 100))
    with pytest.raises(ValueError):
        T.Writer(io.BytesIO(), 12)


def zstd_error():
    import zstandard

    return zstandard.ZstdError


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_documents_round_trip(spark, docs, kind):
    folder = f"{checkpoint_dir(spark)}/ids-test-{kind}"
    files = T.write(docs.repartition(5), FILE, folder, kind, block=1024, file_ids=5000)
    want = plain_rows(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(map(tuple, T.read(files, folder, with_ids=True).collect())) == want
    made = files.orderBy("start").collect()
    assert len(made) > 4 and sum(r["n_docs"] for r in made) == len(want)
    assert [r["start"] for r in made] == np.cumsum([0, *[r["n_ids"] for r in made]]).tolist()[:-1]
    # any range of the whole sequence, across blocks, documents and files
    flat = b"".join(r[4] for r in want)
    total = len(flat) // 4
    asked = [(0, 10), (4990, 40), (0, total), (total - 3, 100), (total, 5), (12345, 2048)]
    got = {}
    for r in T.ranges(files, folder, spark.createDataFrame(asked, "start long, length long")).collect():
        got.setdefault((r["start"], r["length"]), []).append((r["offset"], bytes(r["ids"])))
    for lo, n in asked:
        assert b"".join(ids for _, ids in sorted(got.get((lo, n), []))) == flat[4 * lo: 4 * (lo + n)]


def test_odd_rows(odd_docs, no_docs):
    got = odd_docs.transform(lambda d: T.round_trip(d, FILE)).collect()
    assert T.round_trip(no_docs, FILE).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    # ids with one row have one place; rows that share an id follow each other in some order of their own
    order = sorted({(i is None, i or 0) for i, _ in rows})
    lengths = {}
    for doc_id, start, n, crc in sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]):
        lengths.setdefault((doc_id is None, doc_id or 0), []).append((start, n, crc))
    assert list(lengths) == order
    at = 0
    for key in order:
        for start, n, _ in lengths[key]:
            assert start == at
            at += n
        own = [(i, t) for i, t in rows if (i is None, i or 0) == key]
        assert sorted((n, crc) for _, n, crc in lengths[key]) == sorted((r[2], r[3]) for r in plain_rows(own))
    assert next(r for r in got if r["doc_id"] == 3)["n_tokens"] == 1


def test_one_id_for_a_third_of_the_rows(docs):
    hot = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")))
    got = T.round_trip(hot, FILE).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    want = plain_rows([(r["doc_id"], r["text"]) for r in hot.collect()])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i, n, crc) for i, _, n, crc, _ in want)
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)
