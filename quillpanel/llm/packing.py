"""Documents into sequences of a fixed number of tokens, by bulk-synchronous best fit.

1. Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens.
2. Pieces are range-sorted by (length, id): a piece's rank among those of its
   length is its place in its slice plus the counts of the slices before.
3. A sweep goes through the lengths, longest first.  In each of its steps all
   pieces of one length look up the successor, the smallest gap that takes them;
   if there are more pieces than places, the first by rank get them and the others
   go on to the next gap, or open sequences.  The gaps are then updated.
4. Every piece finds the step that placed its rank, and from it sequence and offset.

Pieces of one length are alike, and so are gaps of one size, so a step moves
counts and ranges of numbers, not rows: steps 1, 2 and 4 run over the rows on the
executors, step 3 over two histograms of ``CAPACITY`` entries each.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import TwoGenerations, give_back, stored, text_of, text_slices

CAPACITY = 4096
END = 1
CACHE = 600_000
#: Pieces that one slice of the range sort holds, about.
SLICE_ROWS = 50_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Chunks:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembered by chunk between blanks."""

    #: The vocabulary's own split of normalised text (fixed value, from its file).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Below this character no text needs composing and all libraries agree on classes and case.
    PLAIN = "ɐ"
    #: Marks that are a token's beginning of their own after a word.
    STOPS = frozenset(".,;:!?|")

    def __init__(self, data: str):
        self.tokenizer = Tokenizer.from_str(data)
        self.model, self.split = self.tokenizer.model, regex.compile(self.SPLIT)
        self.shown = _printable_bytes()
        #: Tokens that the library takes out of a text before it splits it; a lower-case test misses none of them.
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.chunks, self.words = TwoGenerations(CACHE), TwoGenerations(CACHE // 2)

    def _fill(self, wanted: set[str]) -> None:
        alone, found, young = {}, {}, self.chunks.young
        for chunk in wanted:
            word = chunk.lower()
            if not (chunk.isascii() or max(chunk) < self.PLAIN) or any(t in word for t in self.added):
                young[chunk] = packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            elif word.isalpha():
                alone[chunk] = word
            elif word[-1:] in self.STOPS and word[:-1].isalpha():
                found[chunk] = (word[:-1], word[-1])
            else:
                found[chunk] = tuple(self.split.findall(word))
        for word in self.words.wanted(set(alone.values()).union(*found.values())):
            plain = word.isascii() and word.isprintable()
            shown = word if plain else "".join(map(self.shown.__getitem__, word.encode()))
            self.words.young[word] = packed([t.id for t in self.model.tokenize(shown)])
        look = self.words.young.__getitem__
        for chunk, word in alone.items():
            young[chunk] = look(word)
        for chunk, pieces in found.items():
            young[chunk] = b"".join(map(look, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """White space always ends a token and is dropped, so chunks between blanks are independent."""
        split = [text.split(" ") for text in texts]
        self._fill(self.chunks.wanted(set(chain.from_iterable(split))))
        look = self.chunks.young.__getitem__
        return [b"".join(map(look, parts)) for parts in split]


@lru_cache(maxsize=2)
def _chunks(data: str) -> Chunks:
    return Chunks(data)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end: int = END, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ``ids``, little-endian bytes, if asked for) of every piece.

    A document is its ids and ``end``; only one longer than ``capacity`` is cut.
    NULL texts are empty: one piece of one token.
    """
    with open(path, encoding="utf-8") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    ending = packed([end])
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("piece", T.IntegerType(), False),
                           *[T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32")],
                           *([T.StructField("ids", T.BinaryType(), False)] * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(data.value)
        for whole in batches:
            for batch in text_slices(whole, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, body in enumerate(chunks.encode(batch.column(1).to_pylist())):
                    body += ending
                    for k, a in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[a:a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           *[pa.array(v, pa.int64()) for v in (start, length, crc)],
                           *([pa.array(ids, pa.binary())] * with_ids)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        # A full cache takes more than 200 MB, which a worker would keep beside the stages of later jobs.
        del chunks
        _chunks.cache_clear()
        give_back()

    out = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, pieces for each sequence, offset).

    ``counts`` has the number of pieces of each length.  Open sequences are kept
    as ranges of numbers with the same gap; the successor of a length is found in
    a bit set of the gaps that occur.
    """
    steps, ranges, present, opened = [], {}, 0, 0

    def add(gap: int, first: int, many: int) -> None:
        nonlocal present
        if gap and many:
            ranges.setdefault(gap, deque()).append((first, many))
            present |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            above = present >> length
            gap = length + (above & -above).bit_length() - 1 if above else capacity
            each = gap // length
            if above:
                first, many = ranges[gap].popleft()
                if not ranges[gap]:
                    present &= ~(1 << gap)
            else:
                first, many = opened, -(-left // each)
                opened += many
            used = min(many, -(-left // each))
            placed = min(left, used * each)
            steps.append((length, rank, placed, first, each, capacity - gap))
            full, rest = divmod(placed, each)
            add(gap - each * length, first, full)
            if rest:
                add(gap - rest * length, first + full, 1)
            if many > used:  # what is left of the range stays the next to be taken
                ranges.setdefault(gap, deque()).appendleft((first + used, many - used))
                present |= 1 << gap
            rank, left = rank + placed, left - placed
    return steps


def ranked_by_length(pieces: DataFrame, id_col: str) -> DataFrame:
    """Add ``_rank``, from 0 among the pieces of one length, by a range sort; a common length fills many slices."""
    rows = pieces.count()
    slices = max(2, -(-rows // SLICE_ROWS))
    cut = stored(pieces.repartitionByRange(slices, "length", f"`{id_col}`", "piece")
                 .withColumn("_slice", F.spark_partition_id()))
    ahead = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_slice", "length").agg(F.count(F.lit(1)).alias("_n")).select(
        "_slice", "length", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice", "length").orderBy(f"`{id_col}`", "piece")
    return cut.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["_slice", "length"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before")).drop("_slice", "_before")


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: places in a sequence are gapless from 0.

    ``pieces`` has the id, ``piece`` and ``length`` from 1 to ``capacity``, and is
    read more than once: pass a stored table.  Rows that agree in all columns are
    packed each on its own; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = np.array(sweep(counts, capacity), dtype=np.int64).reshape(-1, 6)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    held = spark.sparkContext.broadcast(steps)
    ranked = ranked_by_length(pieces, id_col)
    names = [n for n in ranked.columns if n != "_rank"]
    schema = T.StructType([*[ranked.schema[n] for n in names], T.StructField("sequence_id", T.LongType(), False),
                           T.StructField("offset", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy().astype(np.int64) for n in ("length", "_rank"))
            step = table[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            place = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(step[:, 3] + place // step[:, 4]),
                 pa.array(step[:, 5] + place % step[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences; the tokens are read once."""
    return pack(stored(token_pieces(docs, path, id_col, text)), id_col)
