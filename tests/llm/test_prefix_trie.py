"""The trie of rebuilt conversations against one made of whole texts."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quillpanel.llm import prefix_trie as pt
from quillpanel.llm.queries import QUERIES

from ..conftest import SMALL

CLASHING = ["conv", "depth", "k1", "a", "b", "chars", "base", "head", "owner", "tie"]
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       *[T.StructField(n, T.StringType()) for n in CLASHING]])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def odd_rows():
    rng = random.Random(6)
    words = ["yes", "no", "é😀", "", None, "why " * 30]
    rows = [(c, i, rng.choice(["user", "assistant", None]), rng.choice(words))
            for c in [*range(0, 60), *range(100, 160), *range(230, 260), 5000, -5, -100, -203] for i in range(rng.randint(1, 9))]
    rows += [(c, i, "user", f"copy {i}") for c in range(300, 400) for i in range(7)]       # one conversation many times
    rows += [(401, i // 2, "user", f"long {i % 50}") for i in range(400)]                  # long, with tied turns
    rows += [(402, 1, "user", "again")] * 40                                               # one turn many times
    rows += [(403, None, "user", "null turn"), (403, -1, "user", "below"), (403, None, None, None), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("slices", [False, True])
def test_against_brute_force(spark, monkeypatch, slices):
    rows = odd_rows()
    if slices:
        monkeypatch.setattr(pt, "DEPTHS", 7)
        monkeypatch.setattr(pt, "IDS", 3)
        monkeypatch.setattr(pt, "CELLS", 1 << 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert got(pt.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_products_compose():
    base, rng = pt.bases(3), np.random.default_rng(0)
    parts = [(n, rng.integers(0, pt.PRIME, pt.LANES).tolist()) for n in (3, 0, 5)]
    parts[1] = (0, [0] * pt.LANES)
    left = pt.compose(pt.compose(parts[0], parts[1], base), parts[2], base)
    assert left == pt.compose(parts[0], pt.compose(parts[1], parts[2], base), base) and left[0] == 8
    assert pt.powers(7, np.array([0, 1, 5, 2 ** 33])).tolist() == [pow(7, e, pt.PRIME) for e in (0, 1, 5, 2 ** 33)]


def test_collisions_are_found(spark, monkeypatch):
    rows = [(c, i, "user", f"{c} {i}") for c in range(1, 40) for i in range(8)]
    real = pt._digest
    monkeypatch.setattr(pt, "_digest", lambda seed: [c % 5 for c in real(seed)] if seed < 2 else real(seed))
    assert got(pt.prefix_trie(frame(spark, rows))) == brute(rows)
    monkeypatch.setattr(pt, "_digest", lambda seed: [c % 5 for c in real(seed)])
    with pytest.raises(RuntimeError):
        pt.prefix_trie(frame(spark, rows))


def test_mixed_nodes_are_found(spark):
    same = dict(len=1, depth=1, k1=7, k2=7, p1=0, p2=0, a=1, b=1, chars=3, turn_conv=1, turn_pos=0)
    rows = [dict(same, conv=1), dict(same, conv=2)]
    assert pt._nodes(spark.createDataFrame(rows))[1]
    for column in ("p1", "p2", "a", "b"):
        assert not pt._nodes(spark.createDataFrame([rows[0], {**rows[1], column: 9}]))[1]


def test_empty_and_turnless(spark):
    assert got(pt.prefix_trie(frame(spark, []))) == []
    assert got(pt.prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []
    # crc32("5") % 6 is above 0: the one turn is cut, and there is no conversation 0.
    rows = [(5, 0, "user", "gone")]
    assert zlib.crc32(b"5") % 6 and got(pt.prefix_trie(frame(spark, rows))) == brute(rows) and len(brute(rows)) == 1


def test_stored_turns(spark):
    rows = odd_rows()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: sorted(t) for c, t in own.items()}
    chars = 0
    for r in pt.prefix_trie(frame(spark, rows)).where("depth > 0").collect():
        chars += (r.n_convs - 1) * len(own[r.turn_conv][r.turn_pos][3])
    assert chars == next(r[6] for r in brute(rows) if r[1] == 0)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, SMALL)) == brute(rows)
