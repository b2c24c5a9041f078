"""Cases in which an operator once did a part of its job."""

import os
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm.conftest import rows
from tests.oracle_check import compare, connect
from tidemark.llm import exact_dedup, knn, lines, packing, quality, warc

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_get_the_ids_of_the_library(spark):
    """The call of the library with ``add_special_tokens=False`` and nothing else."""
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}x", f"é 日本{end}", "<|endoftext", "|> plain", f"a\n{end}\nb " + "word " * 50, "a < |endoftext| > b"]
    plain = Tokenizer.from_file(FILE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in packing.pack_documents(df, FILE, with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = plain.encode(t, add_special_tokens=False).ids + [packing.END]
        assert got[i]["ids"] == want and got[i]["ids_crc32"] == zlib.crc32(np.asarray(want, "<u4").tobytes())
    assert 50256 in got[0]["ids"] and 50256 not in got[4]["ids"] + got[5]["ids"]


def test_toxic_documents_are_rejected(spark, sf):
    larger = f"{os.path.dirname(sf)}/sf0.1"
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(F.xxhash64("doc_id") % 2 == 0)
    model, toxic = quality.model_for(docs, seen), quality.toxic_model_for(docs, seen)
    held = docs.join(labels.join(seen, "doc_id", "left_anti").where("quality = 1"), "doc_id")
    judged = quality.judge(docs, model, toxic=toxic).join(held.select("doc_id", F.col("toxic").alias("is_toxic")), "doc_id").cache()
    share = lambda k: judged.where(f"is_toxic = {k}").agg(F.avg((~F.col("kept")).cast("int"))).first()[0]
    assert share(1) > 0.5 and share(0) < 0.01
    assert judged.where("kept and toxic").count() == 0 < judged.where("toxic and tail_probability >= 0.5").count()
    assert quality.selected(held, model, toxic=toxic).count() == judged.where("kept").count()
    nothing = quality.toxic_model_for(docs, labels.where("toxic = 0"))
    assert quality.judge(docs, model, toxic=nothing).where("toxic").count() == 0


def test_short_lines_are_removed_too(spark, sf):
    query = "op4_every_line_dedup"
    assert compare(entry.queries()[query](spark, sf), connect(sf), entry.oracle_sql()[query]) == ""
    df = spark.createDataFrame([(1, "Share this page\n\nown"), (2, "x\nshare  this page"), (3, "share this page\n \n")], "doc_id long, text string")
    got = lines.repeated(df, min_words=1).select("doc_id", "start", "keep_doc_id", "occurrences")
    assert rows(got) == [(2, 2, 1, 3), (3, 0, 1, 3)]


def test_passages_in_short_lines_are_one_unit(spark):
    passage = "\n".join(f"line {i} of it" for i in range(20))
    long = "word " * 25
    table = [(1, f"{long}\n{passage}\n\nalone"), (2, f"{passage.upper()}\n{long}\nalone"), (3, "alone")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    removed = lines.repeated(df, "run", 1)
    assert rows(removed.select("doc_id", "unit", "start", "end", "keep_doc_id")) == [(2, 0, 0, len(passage), 1)]
    assert {r["doc_id"]: r["text"] for r in lines.cleaned(df, removed).collect()}[2] == f"{long}\nalone"


def test_an_id_with_many_vectors_gets_all_its_neighbours(spark):
    rng = np.random.default_rng(0)
    table = [(50, [100.0 + 0.01 * i, 0.0]) for i in range(7)] + [(i, rng.normal(size=2).tolist()) for i in range(101, 141) if i % 50]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = rows(knn.search(df, F.col("vec_id") % 50 == 0))
    scaled = {i: np.floor(256 * np.array(v)) for i, v in table}
    own = [np.floor(256 * np.array(v)) for i, v in table if i == 50]
    best = sorted((-max(int(q @ v) for q in own), i) for i, v in scaled.items() if i != 50)[:5]
    assert len(got) == 5 and {(r[0], r[1]) for r in got} == {(50, k) for k in range(1, 6)} and -got[0][3] == best[0][0]


def test_copies_under_one_id_that_differ_in_white_space(spark):
    table = [(1, "a b"), (1, "ab"), (1, "a b"), (2, "a  c"), (2, "ac"), (None, None), (None, " ")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = exact_dedup.kept_documents(df, exact_dedup.deduplicate(df))
    assert rows(out) == sorted([(1, "a b"), (2, "a  c"), (None, " ")], key=repr)


def test_groups_of_payloads_are_written_before_the_join(spark):
    pages = spark.createDataFrame([(i, "same" if i % 3 else str(i)) for i in range(30)], "page_id long, html string")
    found = warc.roles(pages)
    assert found.count() == 19
    assert "count(1)" not in found._jdf.queryExecution().optimizedPlan().toString()
