import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int, shared boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Nodes by the definition, from (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):  # children first
        own_saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children.get(node, [])) or 1
        saved[node] = own_saved + sum(saved[k] for k in children.get(node, []))
    out = []
    for node, cs in members.items():
        end = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA)
    return sorted(map(tuple, P.trie(df, **kw).select(*P.NODE).collect()), key=repr)


@pytest.mark.parametrize(("seed", "bits"), [(0, None), (1, 4), (2, 8)])
def test_nodes_by_the_definition(spark, seed, bits):
    """Also with a sketch so small that nearly every estimate is too high."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["hello there", "hello", "x  y\tz", "", None])) for c in rng.sample(range(-30, 200), 90) for t in range(rng.randrange(1, 7))]
    assert ours(spark, rows, most_bits=bits) == brute(rows)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, P.trie(df).select(*P.NODE).collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "u", "a"), (1, None, None, "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "c"), (None, 1, "u", "a"), (None, None, None, None),
        (2, 5, None, None), (2, 1, "", ""), (3, 1, "ab", "c"), (4, 1, "a", "bc"), (20, 1, "u", "w " * 50_000), (21, 1, "u", "z"), (21, 2, "u", "z"), (21, 3, "q", "z"), (21, 4, "u", "z"),
        (39, 1, "u", "short"), (25, 1, "u", "own"), (0, 1, "s", "top"), (-7, 1, "s", "x"), (-7, 2, "s", "x"), (-7, 3, "s", "x"), (-7, 4, "s", "x"), (9223372036854775807, 1, "u", "a"),
    ]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, [(None, 1, "u", "a")]) == [] and ours(spark, rows[:1]) == brute(rows[:1])
    empty = spark.createDataFrame([], SCHEMA)
    assert P.trie(empty).collect() == [] and P.trie(empty).columns == P.NODE


def test_one_start_and_one_conversation_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_BYTES", 40)
    same = [(c, t, "u", f"same {t}") for c in range(100, 400) if zlib.crc32(str(c).encode()) % 4 == 0 for t in range(3)]
    long = [(500, t, "u", f"turn {t} of many") for t in range(400)]
    rest = [(c, t, "u", "same 0" if t == 0 else f"{c} {t}") for c in range(600, 700) for t in range(3)]
    rows = same + long + rest
    assert ours(spark, rows) == brute(rows)


def test_only_prefixes_that_may_be_shared_are_grouped(spark):
    rows = [(c, t, "u", "start" if t == 0 else f"{c} {t}") for c in range(0, 4000, 20) for t in range(6)]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA)
    sequences, _ = P.rebuilt(P.numbered(df))
    seen = P.screened(P.prefixes(sequences)).select("depth", "shared").collect()
    assert all(r["shared"] for r in seen if r["depth"] == 1)
    assert sum(r["shared"] for r in seen if r["depth"] > 1) < 0.05 * len(seen)


def test_a_sketch_never_counts_too_few(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 62), 1 << 62, 3000)
    a[1000:2000] = a[:1000]
    df = spark.createDataFrame([(int(x), int(x) // 3) for x in a], "a long, b long").repartition(7)
    b = np.array([int(x) // 3 for x in a])
    for bits in (4, 10, 14):
        again = P.sketch(df, bits)
        flagged = P.met_again(again, a, b, bits)
        assert flagged[:2000].all()
    assert flagged[2000:].mean() < 0.05
