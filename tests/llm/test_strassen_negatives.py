"""Hard negatives against brute force in Python's own integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpanel.llm import strassen_negatives as sn
from quillpanel.llm.queries import QUERIES

from ..conftest import SMALL

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()),
                       *[T.StructField(n, T.StringType()) for n in ("id", "codes", "lot", "v", "score", "rank", "slot", "anchor")]])
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, relabel=lambda i, label: label, low=30, high=90, positives=5, negatives=10):
    """All rows of the result by plain loops over exact integers."""
    items = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        items.append((i, relabel(i, label), [math.floor(256 * float(x)) for x in v]))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in items if anchor(i)}:
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in items if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][:positives]:
            inside = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 8) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (64, 64, 64), (70, 33, 91), (128, 20, 130), (40, 0, 7), (5, 64, 300)])
def test_product(shape):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2 ** 62, 2 ** 62, shape[:2]), rng.integers(-2 ** 62, 2 ** 62, shape[1:])
    for leaf in (1, 4, 16):
        assert (sn.multiply(a, b, leaf) == a @ b).all()


def test_shares():
    top = 2 ** 63 - 1
    scores = [0, 1, 9, 10, -1, -7, 333, top, -top]
    assert sn.share(np.array(scores), 30, 100, True).tolist() == [-(-s * 30 // 100) for s in scores]
    assert sn.share(np.array(scores), 90, 100, False).tolist() == [s * 90 // 100 for s in scores]


def test_heaps_in_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-3, 4, (6, 300)), rng.permutation(300)
    for step in (7, 50, 300):
        heaps = sn.Heaps(6, 4)
        for a in range(0, 300, step):
            heaps.offer(slice(0, 6), scores[:, a:a + step], ids[a:a + step])
        for i in range(6):
            want = sorted(zip((-scores[i]).tolist(), ids.tolist()))[:4]
            assert list(zip((-heaps.score[i]).tolist(), heaps.id[i].tolist())) == want


@pytest.mark.parametrize("lot", [4096, 2])
def test_against_brute_force(spark, monkeypatch, lot):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(sn, "ROWS", 64)
    monkeypatch.setattr(sn, "ANCHORS", 3)
    rows = [(i, (rng.normal(size=9) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, rows[40][1], 1 + i % 2) for i in range(200)]          # one vector that many rows hold
    rows += [(20, rows[3][1], 2), (20, rows[3][1], 2), (20, rows[4][1], 3), (33, rows[4][1], 0), (33, rows[4][1], 0)]  # repeats
    rows += [(600, None, 1), (620, rows[0][1], None), (None, rows[0][1], 1), (640, [1.0, None], 1), (660, [float("nan")], 1),
             (680, [float("inf")] * 9, 1), (700, [], 1), (720, [0.0] * 9, 0), (740, [0.5, 0.25], 2), (761, [1.0] * 12, 2)]
    found = got(sn.hard_negatives(frame(spark, rows), F.col("id") % 20 == 0, lot=lot))
    assert found == brute(rows, lambda i: i % 20 == 0) and len(found) > 500


def test_large_components(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [0.0, 3.0], 1), (3, [0.0, 2.0], 2)]
    found = got(sn.hard_negatives(frame(spark, rows), F.col("id") == 0))
    top = 2 ** 63 - 1
    # (2^63 - 1)^2 is 1 modulo 2^64; 768 * 256 and 512 * 256 are exact.
    assert found == [(0, 2, 1, 3, 768 * 256, 512 * 256)] and (top * top) % 2 ** 64 == 1


def test_empty_and_without_anchors(spark):
    assert got(sn.hard_negatives(frame(spark, []), F.col("id") % 20 == 0)) == []
    assert got(sn.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("id") % 20 == 0)) == []
    assert got(sn.hard_negatives(frame(spark, [(20, [1.0], 1)]), F.col("id") % 20 == 0)) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows, lambda i: i % 100 == 0, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert got(QUERIES["op12_hard_negatives"](spark, SMALL)) == want and want
