"""Hard negatives: rows of another label whose score lies in a window below that of an anchor's positives.

Scores are inner products of whole numbers.  Anchors are dealt into lots of
bounded size; a lot goes to the workers, which keep their share of the rows where
it is and multiply it with the lot, tile by tile, by Strassen's recursion on
int64 with zero padding.  Nothing but heaps leaves a worker: of every anchor the
best positives, and in a second pass of every (anchor, positive) the best rows of
its window.  Heaps of different workers are merged by Spark, best first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import stored

#: Anchors of a lot, numbers of a lot (8 bytes each), anchors and rows of a tile, and the side at which the recursion ends.
LOT, LOT_NUMBERS, ANCHORS, ROWS, LEAF = 4_096, 1 << 20, 512, 2_048, 16
#: Score of an empty place in a heap.
NOTHING = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64, by seven half-size products a level."""
    (m, k), n = a.shape, b.shape[1]
    levels = max(0, (max(1, min(m, k, n)) - 1).bit_length() - (leaf - 1).bit_length())
    side = 1 << levels
    padded = [np.pad(x, [(0, -s % side) for s in x.shape]) for x in (a, b)]
    return _strassen(*padded, levels)[:m, :n]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return np.einsum("ik,kj->ij", a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.zeros((2 * m, 2 * n), dtype=np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    for left, right, plus, minus in (
            (a11 + a22, b11 + b22, (c11, c22), ()), (a21 + a22, b11, (c21,), (c22,)), (a11, b12 - b22, (c12, c22), ()),
            (a22, b21 - b11, (c11, c21), ()), (a11 + a12, b22, (c12,), (c11,)), (a21 - a11, b11 + b12, (c22,), ()),
            (a12 - a22, b21 + b22, (c11,), ())):
        part = _strassen(left, right, levels - 1)
        for c in plus:
            c += part
        for c in minus:
            c -= part
    return out


class Heaps:
    """The ``keep`` best (score, id) of each of ``count`` owners: higher scores first, then smaller ids."""

    def __init__(self, count: int, keep: int):
        self.score = np.full((count, keep), NOTHING, dtype=np.int64)
        self.id = np.full((count, keep), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, owners: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in one tile: ``scores`` (owners by rows) with ``NOTHING`` where a row does not count."""
        held, named = self.score[owners], self.id[owners]
        keep, worst, last = held.shape[1], held[:, -1:], named[:, -1:]
        hits = (scores > worst) | ((scores == worst) & (ids[None, :] < last) & (scores != NOTHING))
        if hits.sum() > 4 * keep * len(held) and scores.shape[1] > keep:
            # Most of the tile would pass: nothing below its own ``keep`` best is needed.
            hits &= scores >= np.partition(scores, -keep, axis=1)[:, -keep][:, None]
        row, column = np.nonzero(hits)
        if not len(row):
            return
        touched = np.unique(row)
        old = np.repeat(touched, keep)
        row = np.concatenate([old, row])
        score = np.concatenate([held[touched].ravel(), scores[hits]])
        name = np.concatenate([named[touched].ravel(), ids[column]])
        order = np.lexsort((name, ~score, row))
        row, score, name = row[order], score[order], name[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        place = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
        best = place < keep
        held[row[best], place[best]], named[row[best], place[best]] = score[best], name[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, id, score) of all that is held."""
        owner, place = np.nonzero(self.score != NOTHING)
        return owner, self.id[owner, place], self.score[owner, place]


def share(scores: np.ndarray, part: int, whole: int, up: bool) -> np.ndarray:
    """``scores * part / whole`` rounded up or down, without overflow for ``part <= whole``."""
    times, rest = scores // whole, scores % whole * part
    return times * part + (-(-rest // whole) if up else rest // whole)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``size``, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    length, values = np.diff(ends), column.values.to_numpy()
    out = np.zeros((len(column), size), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], length)] = values[ends[0]:ends[-1]]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], lot: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, scores, same label, ids) of every tile of a task's rows, its rows in the order of their ids."""
    size = lot["codes"].shape[1]
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
        codes = _matrix(batch.column(2), size)
        for a in range(0, len(ids), ROWS):
            order = a + np.argsort(ids[a:a + ROWS], kind="stable")
            across = np.ascontiguousarray(codes[order].T)
            for b in range(0, len(lot["id"]), ANCHORS):
                part = slice(b, b + ANCHORS)
                yield part, multiply(lot["codes"][part], across), lot["label"][part][:, None] == labels[order], ids[order]


def _emitted(heaps: Heaps, slot: int) -> pa.RecordBatch:
    owner, name, score = heaps.entries()
    return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(np.full(len(owner), slot, dtype=np.int32)),
                                       pa.array(name), pa.array(score)], names=["anchor", "slot", "id", "score"])


HEAP = "anchor int, slot int, id long, score long"


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """Heaps of all tasks merged: ``rank`` from 1 for each (anchor, slot)."""
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def whole_rows(rows: DataFrame, id_col: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label, codes of the rows that take part; codes are ``floor(scale * component)`` as 64-bit numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return plain.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(
        F.coalesce(finite, F.lit(False))).select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("codes"))


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: Column | None = None,
                   vector: str = "embedding", positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100),
                   high: tuple[int, int] = (90, 100), scale: int = 256, lot: int = LOT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``id``; ``label`` defaults to the
    column of that name.  An anchor's positives are its ``positives`` best rows of
    its own label; for each, ``negatives`` rows of other labels follow whose score
    lies between the shares ``low`` and ``high`` (whole numbers part, whole; part
    at most whole) of the positive's.  Higher scores come first, then smaller ids.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take
    no part; zero and empty vectors do, and a shorter vector counts as filled up
    with zeros.  Rows with the anchor's own id are no candidates of it; otherwise
    repeated rows count one by one, and equal anchors are searched once.  A
    component beyond 64 bits is the largest number there, and products are exact
    modulo 2^64.  An empty table, or one without anchors, gives no rows.

    Each lot of at most about ``lot`` anchors is broadcast (8 MB of codes) and
    takes two scans of the stored rows, which are never shuffled.
    """
    spark = rows.sparkSession
    table = stored(whole_rows(rows, id_col, F.col("label") if label is None else label, vector, scale))
    size = table.agg(F.max(F.size("codes"))).first()[0] or 1
    asked = table.where(anchors).distinct()
    lots = max(1, -(-asked.count() // max(1, min(lot, LOT_NUMBERS // size))))
    asked = stored(asked.withColumn("lot", F.pmod(F.xxhash64("id", "label", "codes"), F.lit(lots))))
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    for i in range(lots):
        _mine(table, asked.where(F.col("lot") == i), size, positives, negatives, low, high).write.parquet(f"{path}/lot={i}")
    return spark.read.schema(RESULT).parquet(path).drop("lot")


def _mine(table: DataFrame, asked: DataFrame, size: int, positives: int, negatives: int, low: tuple[int, int],
          high: tuple[int, int]) -> DataFrame:
    """The result for one lot of anchors."""
    spark = table.sparkSession
    local = asked.drop("lot").sort("id", "label", "codes").toArrow()
    lot = {"id": local.column("id").to_numpy(), "label": local.column("label").to_numpy(),
           "codes": _matrix(local.column("codes"), size) if local.num_rows else np.zeros((0, size), dtype=np.int64)}
    count = len(lot["id"])
    held = spark.sparkContext.broadcast(lot)

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, heaps = held.value, Heaps(count, positives)
        for part, scores, same, ids in _tiles(batches, given):
            heaps.offer(part, np.where(same & (given["id"][part][:, None] != ids), scores, NOTHING), ids)
        yield _emitted(heaps, 0)

    found = _merged(table.mapInArrow(best_positives, HEAP), positives).select("anchor", "rank", "id", "score").toArrow()
    at = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
    # Windows without a positive are empty: no score lies between 1 and 0.
    least, most = np.ones((count, positives), dtype=np.int64), np.zeros((count, positives), dtype=np.int64)
    score = found.column("score").to_numpy()
    least[at], most[at] = share(score, *low, up=True), share(score, *high, up=False)
    windows = spark.sparkContext.broadcast((least, most))

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (floor, ceiling), given, slots = windows.value, held.value, [Heaps(count, negatives) for _ in range(positives)]
        for part, scores, same, ids in _tiles(batches, given):
            other = np.where(same | (given["id"][part][:, None] == ids), NOTHING, scores)
            for j, heaps in enumerate(slots):
                inside = (other >= floor[part, j][:, None]) & (other <= ceiling[part, j][:, None])
                heaps.offer(part, np.where(inside, other, NOTHING), ids)
        for j, heaps in enumerate(slots):
            yield _emitted(heaps, j)

    mined = _merged(table.mapInArrow(best_negatives, HEAP), negatives)
    # The lot's anchors and positives, at most ``lot`` times ``positives`` rows.
    names = spark.createDataFrame(pa.table({
        "anchor": found.column("anchor"), "slot": pa.array(at[1].astype(np.int32)),
        "anchor_id": pa.array(lot["id"][at[0]], pa.int64()), "positive_id": found.column("id"),
        "positive_score": found.column("score")}))
    return mined.join(F.broadcast(names), ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
