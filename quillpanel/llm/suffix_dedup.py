"""Removal of byte strings of a given length that occur more than once.

A suffix array by bucket-pointer refinement, kept only where it can matter.  The
suffixes looked at are anchors: every window of ``LENGTH`` bytes chooses the
position in it whose 8-byte value has the smallest hash, so two equal windows
choose the same place, about one in ``LENGTH / 2`` positions.

* Initial buckets: anchors with the same ``GRAM`` bytes.  Buckets of one leave.
  A second identifier covers all bytes touched by the windows that chose the
  anchor; in a bucket whose second identifiers all agree every window repeats.
* Refinement: in the other buckets the window starts of an anchor are cut into
  runs aligned to their distance from it, of 64 starts, then 16, 4 and 1.  A run's
  bucket is the identifier of the bytes that all its windows share, taken at the
  run's own offset from the anchor; the second identifier covers what its windows
  touch.  Again a bucket of one holds no repeat, one that agrees is settled, and
  the rest is refined by shorter runs at later offsets, down to single windows.

Identifiers are fingerprints rather than ranks (a decision rests on two 64-bit
ones), so that a bucket is a count by key: no global order is needed, common strings are summed before the
shuffle, and members find their bucket by a join that Spark can split.  Which
buckets a scan has to look into again is kept as a bitmap of fixed size; a full
bitmap makes the next scan emit more rows and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_array, bitmap_test, bits_for, repeated_cells, stored, text_of, text_slices, texts_in

LENGTH = 400
GRAM = 64
WIDTHS = (64, 16, 4, 1)
#: Bytes looked at together, bits of a position among them, and most cells of a bitmap (16 MB).
SEGMENT, PLACE, MOST_CELLS = 1 << 20, 22, 1 << 27
#: Odd multipliers of the anchor hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def window_anchors(data: bytes, length: int, gram: int) -> np.ndarray:
    """For each window start in ``data`` the anchor its window chooses: leftmost smallest hash of 8 bytes."""
    starts = len(data) - length + 1
    span = length - gram + 1
    size = starts + span - 1
    values = np.empty(size, dtype=np.uint64)
    for o in range(min(8, size)):
        many = -(-(size - o) // 8)
        values[o::8] = np.frombuffer(data + b"\0" * 8, dtype="<u8", count=many, offset=o)
    values *= MIX[0]
    values ^= values >> np.uint64(29)
    values *= MIX[1]
    values = (values >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(size, dtype=np.uint64)
    padded = np.full(-(-size // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:size] = values
    blocks = padded.reshape(-1, span)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:starts], forward[span - 1:span - 1 + starts])
            & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def runs_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Segments of many texts joined: (bytes, runs, origin of each run).

    A run is (anchor, first start, last start) in the segment's bytes; the origin
    is (text number, what to add for a position in the text).
    """
    group, where, total = [], [], 0

    def flush():
        data = b"".join(group)
        if len(data) < length:
            return None
        chosen = window_anchors(data, length, gram)
        begins = np.cumsum([0, *map(len, group)])
        rows, origins = [], []
        for (number, offset), a, b in zip(where, begins[:-1].tolist(), begins[1:].tolist()):
            own = chosen[a:b - length + 1]
            edge = np.flatnonzero(np.diff(own)) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(own)]]) - 1
            rows.append(np.stack([own[first], first + a, last + a], axis=1))
            origins.append(np.tile([number, offset - a], (len(first), 1)))
        return data, np.concatenate(rows), np.concatenate(origins)

    for number, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, SEGMENT):
            part = text[offset:offset + SEGMENT + length - 1]
            if total + len(part) > 2 * SEGMENT and group:
                yield flush()
                group, where, total = [], [], 0
            group.append(part)
            where.append((number, offset))
            total += len(part)
    if group:
        yield flush()


def gram_hashes(data: bytes, runs: np.ndarray, gram: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[p:p + gram]) for p in runs[:, 0].tolist()], dtype=np.uint64).view(np.int64)


def cut_runs(data: list[bytes], runs: list[tuple[int, int, int, int]], width: int, length: int, gram: int):
    """Runs of ``width`` starts within (text number, anchor, first, last): (runs, core and hull identifiers)."""
    out, core, hull, digest = [], [], [], xxhash.xxh3_64_intdigest
    if width == 1:  # core and hull are the same bytes, the window: halves of one identifier
        whole, rows = xxhash.xxh3_128_digest, np.array(runs, dtype=np.int64).reshape(-1, 4)
        many = rows[:, 3] - rows[:, 2] + 1
        at = np.repeat(rows[:, 2] - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = b"".join([whole(data[i][x:x + length]) for i, _, a, b in runs for x in range(a, b + 1)])
        core, hull = np.frombuffer(both, dtype="<i8").reshape(-1, 2).T.copy()
        return np.column_stack([np.repeat(rows[:, :2], many, axis=0), at, at]), core, hull
    for i, p, a, b in runs:
        body = data[i]
        for k in range((a - p) // width, (b - p) // width + 1):
            at = p + k * width
            lo, hi = max(a, at), min(b, at + width - 1)
            out.append((i, p, lo, hi))
            # All windows of an aligned run hold these bytes, and all hold the anchor's gram.
            core.append(digest(body[min(at + width - 1, p):max(at + length, p + gram)], k & 0xFFFFFFFF))
            hull.append(digest(body[lo:hi + length], p - lo + 1))
    return out, *(np.array(v, dtype=np.uint64).view(np.int64) for v in (core, hull))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, a hash of the text (so that equal ids with other texts stay apart), text."""
    whole = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text"))
    return whole.select("_id", F.xxhash64("_text").alias("_digest"), "_text")


def _gram_rows(long_docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 0):
                for data, runs, _ in runs_of(list(texts_in(batch.column(0))), length, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(data, runs, gram))], names=["gram"])

    return long_docs.select("_text").mapInArrow(run, "gram long")


ROW = [T.StructField("_digest", T.LongType(), False), T.StructField("lo", T.LongType(), False),
       T.StructField("hi", T.LongType(), False), T.StructField("core", T.LongType(), False),
       T.StructField("hull", T.LongType(), False)]
CONTEXT = [T.StructField("_digest", T.LongType(), False), T.StructField("anchor", T.LongType(), False),
           T.StructField("lo", T.LongType(), False), T.StructField("hi", T.LongType(), False),
           T.StructField("around", T.BinaryType(), False)]


def _anchor_rows(long_docs: DataFrame, grams: np.ndarray, length: int, gram: int, context: bool) -> DataFrame:
    """Anchors whose gram is in the bitmap: their run's identifiers, or the bytes their windows touch."""
    held = long_docs.sparkSession.sparkContext.broadcast(grams)
    schema = T.StructType([long_docs.schema["_id"], *(CONTEXT if context else ROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in text_slices(whole, 2):
                for data, runs, origin in runs_of(list(texts_in(batch.column(2))), length, gram):
                    core = gram_hashes(data, runs, gram)
                    keep = bitmap_test(held.value, core)
                    runs, origin, core = runs[keep], origin[keep], core[keep]
                    row = pa.array(origin[:, 0])
                    columns = [batch.column(0).take(row), batch.column(1).take(row)]
                    placed = [pa.array(runs[:, i] + origin[:, 1]) for i in range(3)]
                    if context:
                        around = [data[a:b + length] for a, b in runs[:, 1:].tolist()]
                        columns += [*placed, pa.array(around, pa.binary())]
                    else:
                        hull = np.array([digest(data[a:b + length], p - a + 1) for p, a, b in runs.tolist()],
                                        dtype=np.uint64).view(np.int64)
                        columns += [*placed[1:], pa.array(core), pa.array(hull)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return long_docs.mapInArrow(run, schema)


def _level_rows(contexts: DataFrame, maps: list[np.ndarray], length: int, gram: int) -> DataFrame:
    """Runs of the next width within the cores that ``maps`` (one for each width before) leave open."""
    held = contexts.sparkSession.sparkContext.broadcast(maps)
    schema = T.StructType([contexts.schema["_id"], *ROW])
    widths = WIDTHS[:len(maps) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, lo, hi = (batch.column(i).to_numpy() for i in (2, 3, 4))
            data = batch.column(5).to_pylist()
            runs = list(zip(range(len(data)), (anchor - lo).tolist(), [0] * len(data), (hi - lo).tolist()))
            for i, width in enumerate(widths):
                runs, core, hull = cut_runs(data, runs, width, length, gram)
                if i < len(widths) - 1:
                    runs = [runs[j] for j in np.flatnonzero(bitmap_test(held.value[i], core)).tolist()]
            if len(runs):
                place = np.asarray(runs, dtype=np.int64)
                row = pa.array(place[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(place[:, 2] + lo[place[:, 0]]),
                     pa.array(place[:, 3] + lo[place[:, 0]]), pa.array(core), pa.array(hull)], names=schema.names)

    return contexts.mapInArrow(run, schema)


def _settle(rows: DataFrame, bits: int, last: bool) -> tuple[DataFrame, np.ndarray | None]:
    """(runs whose windows all repeat, bitmap of the cores that are still open)."""
    if last:  # a single window: both identifiers name the same bytes
        settled = rows.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        return stored(rows.join(stored(settled), ["core", "hull"]).select("_id", "_digest", "lo", "hi")), None
    buckets = stored(rows.groupBy("core").agg(F.count(F.lit(1)).alias("_n"), F.min("hull").alias("_least"),
                                              F.max("hull").alias("_most")).where("_n > 1"))
    settled = buckets.where("_least = _most").select("core")
    found = stored(rows.join(settled, "core").select("_id", "_digest", "lo", "hi"))
    return found, bitmap_array(repeated_cells(buckets.where("_least <> _most"), "core", bits, 1), bits)


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                    gram: int = GRAM, most_cells: int = MOST_CELLS) -> DataFrame:
    """(_id, _digest, lo, hi): inclusive runs of starts whose ``length`` bytes also start elsewhere, in any order."""
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and shorter than length")
    long_docs = _keyed(docs, id_col, text).where(F.octet_length("_text") >= length)
    size = long_docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = bits_for(2 * size // (length - gram), 16, most_cells)
    grams = bitmap_array(repeated_cells(_gram_rows(long_docs, length, gram), "gram", bits), bits)
    found, open_grams = _settle(stored(_anchor_rows(long_docs, grams, length, gram, False)), bits, False)
    contexts = stored(_anchor_rows(long_docs, open_grams, length, gram, True))
    parts, maps = [found], []
    for width in WIDTHS:
        found, still_open = _settle(stored(_level_rows(contexts, maps, length, gram)), bits, width == 1)
        parts.append(found)
        maps.append(still_open)
    return reduce(DataFrame.unionAll, parts)


def merged_spans(runs: pa.ListArray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the bytes under each row's runs of window starts, where they meet or overlap as one span.

    The rows are laid out one after the other, a byte apart, so that one sort and
    one running maximum serve them all; ``size`` is the length of each row's text.
    """
    lo, hi = (np.asarray(v.to_numpy(zero_copy_only=False), dtype=np.int64) for v in runs.flatten().flatten())
    owner = np.repeat(np.arange(len(size)), np.asarray(pa.compute.list_value_length(runs)))
    base = np.cumsum(size + 1) - size - 1
    lo, hi = lo + base[owner], hi + length + base[owner]
    order = np.argsort(lo)
    lo, hi, owner = lo[order], np.maximum.accumulate(hi[order]), owner[order]
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.empty(0, dtype=np.int64)
    last = np.append(first[1:], len(lo))[:len(first)] - 1
    return owner[first], lo[first] - base[owner[first]], hi[last] - base[owner[first]]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                gram: int = GRAM, most_cells: int = MOST_CELLS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (bytes) and spans ([start, end) in bytes) of every document.

    A byte goes if a ``length``-byte string that covers it starts at another
    place too, in any document, the same one included; all judged on the input.
    NULL and short texts lose nothing, an empty table gives no rows, rows that
    agree in id and text count as two places, other columns are ignored.
    """
    starts = stored(repeated_starts(docs, id_col, text, length, gram, most_cells))
    hits = starts.groupBy("_id", "_digest").agg(F.collect_list(F.struct("lo", "hi")).alias("_runs"))
    bits = bits_for(hits.count(), 16, most_cells)
    touched = bitmap_array(repeated_cells(starts.select(F.xxhash64("_id", "_digest").alias("key")), "key", bits, 1), bits)
    rows = _keyed(docs, id_col, text)
    held = docs.sparkSession.sparkContext.broadcast(touched)

    @F.pandas_udf("boolean")
    def maybe_touched(key: pd.Series) -> pd.Series:
        return pd.Series(bitmap_test(held.value, key.to_numpy()))

    flagged = rows.withColumn("_maybe", maybe_touched(F.xxhash64("_id", "_digest")))
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    alone = flagged.where(~F.col("_maybe")).drop("_maybe").withColumn("_runs", nothing)
    joined = (flagged.where("_maybe").drop("_maybe").alias("d")
              .join(hits.alias("h"), F.col("d._id").eqNullSafe(F.col("h._id"))
                    & (F.col("d._digest") == F.col("h._digest")), "left")
              .select("d._id", "d._digest", "d._text", F.coalesce("h._runs", nothing).alias("_runs")))
    schema = T.StructType([rows.schema["_id"], *[T.StructField(n, T.LongType(), False)
                                                 for n in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept", T.BinaryType(), False),
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())), False)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                bodies = list(texts_in(batch.column(1)))
                size = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
                owner, lo, hi = merged_spans(batch.column(2), size, length)
                kept, stops = list(bodies), np.searchsorted(owner, np.arange(len(bodies) + 1))
                for i in np.unique(owner).tolist():
                    a, b = stops[i:i + 2]
                    edges = [0, *np.stack([lo[a:b], hi[a:b]], axis=1).ravel().tolist(), len(bodies[i])]
                    kept[i] = b"".join(bodies[i][x:y] for x, y in zip(edges[::2], edges[1::2]))
                ends = pa.array(np.stack([lo, hi], axis=1).ravel())
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(lo) + 1, 2, dtype=np.int32)), ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size),
                     pa.array(size - np.fromiter(map(len, kept), dtype=np.int64, count=len(kept))),
                     pa.array(np.diff(stops).astype(np.int64)), pa.array(kept, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pairs)], names=schema.names)

    out = alone.select("_id", "_text", "_runs").unionAll(joined.select("_id", "_text", "_runs"))
    return out.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)
