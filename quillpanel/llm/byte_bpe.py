"""Byte-level BPE: texts to ids by a rank file, and ids back to bytes.

Each match of the split pattern is encoded on its own.  Its bytes are the leaves
of a segment tree whose nodes keep the smallest (rank, position) of a pair that
starts below them, so the root is the leftmost pair of least rank.  A merge
changes three leaves (the pair, its right half, the live neighbour to the left)
and the nodes above them: logarithmic work.  Trees of equal size are kept in one
array and advance together, one merge each at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, text_of, text_slices

NONE = np.int64(1 << 62)
#: Entries of a worker's cache of text chunks, leaves of one batch of trees, bytes of text taken at a time.
CACHE, LEAVES, SLICE = 350_000, 1 << 18, 4 << 20


def read_ranks(path: str) -> bytes:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


class Ranks:
    """Tokens, the pairs of tokens that make a token, and their ranks; a token's id is its rank."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ids.items()}
        self.whole = {t: r.to_bytes(4, "little") for t, r in self.ids.items()}
        pairs = sorted((self.ids[t[:i]] << 32 | self.ids[t[i:]], r) for t, r in self.ids.items()
                       for i in range(1, len(t)) if t[:i] in self.ids and t[i:] in self.ids)
        self.keys = np.array([k for k, _ in pairs] + [NONE], dtype=np.int64)
        self.ranks = np.array([r for _, r in pairs] + [0], dtype=np.int64)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it makes no token or a side is absent (-1)."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merged(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each piece, by merges alone, as little-endian 32-bit bytes."""
    out = [b""] * len(pieces)
    sizes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if piece:
            sizes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for leaves, members in sizes.items():
        step = max(1, LEAVES // leaves)
        for a in range(0, len(members), step):
            part = members[a:a + step]
            for i, ids in zip(part, _merge_trees([pieces[i] for i in part], leaves, ranks)):
                out[i] = ids
    return out


def _merge_trees(pieces: list[bytes], leaves: int, ranks: Ranks) -> list[bytes]:
    """The arrays are flat: a piece's tree starts at ``2 * leaves`` times its number, its positions at
    ``leaves + 1`` times that; position ``leaves`` stands for none."""
    depth, count, stride = leaves.bit_length() - 1, len(pieces), leaves + 1
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=count)[:, None]
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(count, leaves)
    at = np.arange(leaves)[None, :]
    ids = np.full((count, stride), -1, dtype=np.int32)
    ids[:, :leaves] = np.where(at < length, ranks.of_byte[raw], -1)
    after = np.full((count, stride), leaves, dtype=np.int32)
    after[:, :leaves] = np.where(at + 1 < length, at + 1, leaves)
    before = np.full((count, stride), leaves, dtype=np.int32)
    before[:, 1:leaves] = at[:, :-1]

    tree = np.full((count, 2 * leaves), NONE, dtype=np.int64)
    first = ranks.pair(ids[:, :leaves].ravel(), ids[:, 1:].ravel()).reshape(count, leaves)
    tree[:, leaves:] = np.where(first < NONE, first << depth | at, NONE)
    level = leaves // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2

    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    roots = np.arange(count, dtype=np.int64)
    best = tree[roots * 2 * leaves + 1]
    live = best < NONE
    roots, best = roots[live], best[live]
    while len(roots):
        base, node = roots * stride, roots * 2 * leaves
        pos, rank = best & (leaves - 1), best >> depth
        right, left = after[base + pos].astype(np.int64), before[base + pos].astype(np.int64)
        beyond = after[base + right]
        ids[base + pos], ids[base + right] = rank, -1
        after[base + pos], before[base + beyond] = beyond, pos
        follows, leads = ranks.pair(rank, ids[base + beyond]), ranks.pair(ids[base + left], rank)
        changed = np.concatenate([node + leaves + pos, node + leaves + right])
        tree[changed] = np.concatenate([np.where(follows < NONE, follows << depth | pos, NONE),
                                        np.full(len(pos), NONE)])
        has = np.flatnonzero(left < leaves)
        leads, earlier = leads[has], left[has]
        own = node[has] + leaves + earlier
        tree[own] = np.where(leads < NONE, leads << depth | earlier, NONE)
        # Node i of a tree has the children 2i and 2i + 1; trees start at multiples of 2 * leaves.
        start = np.concatenate([node, node, node[has]])
        inner = np.concatenate([pos, right, earlier]) + leaves
        for _ in range(depth):
            inner >>= 1
            child = start + 2 * inner
            tree[start + inner] = np.minimum(tree[child], tree[child + 1])
        best = tree[node + 1]
        live = best < NONE
        roots, best = roots[live], best[live]

    kept = ids.reshape(count, stride)[:, :leaves]
    alive = kept >= 0
    flat, ends = kept[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes many texts at once; what a worker has encoded before is looked up."""

    #: Below this character a text of letters only is one match of the pattern.
    PLAIN = "ɐ"
    #: Marks that are a match of their own after a word.
    STOPS = frozenset(".,;:!?|")
    #: A blank next to white space, where the pattern's matches depend on what follows.
    AWKWARD = re.compile(r" \s|\s ")

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), TwoGenerations(CACHE)

    def _known(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of single matches of the pattern: a token as a whole, or by merges."""
        known, whole = {}, self.ranks.whole
        fresh, raw = [], []
        for piece in pieces:
            data = piece.encode()
            ids = whole.get(data)
            if ids is None:
                fresh.append(piece)
                raw.append(data)
            else:
                known[piece] = ids
        known.update(zip(fresh, merged(raw, self.ranks)))
        return known

    def _fill(self, wanted: set[str]) -> None:
        """Encode chunks (which follow a blank) into the cache."""
        alone, found = [], {}
        for chunk in wanted:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) < self.PLAIN):
                alone.append(chunk)
            elif chunk[-1:] in self.STOPS and chunk[:-1].isalpha() and max(chunk) < self.PLAIN:
                found[chunk] = (" " + chunk[:-1], chunk[-1])
            else:
                found[chunk] = tuple(self.pattern.findall(" " + chunk))
        pieces = {" " + c for c in alone}.union(*found.values())
        look, young = self._known(pieces).__getitem__, self.cache.young
        for chunk in alone:
            young[chunk] = look(" " + chunk)
        for chunk, parts in found.items():
            young[chunk] = b"".join(map(look, parts))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        look = self._known(set(chain.from_iterable(found))).__getitem__
        return [b"".join(map(look, parts)) for parts in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes.

        A blank between two characters that are not white space starts a match,
        so what stands between two such blanks is encoded, and remembered, alone.
        """
        odd = [self.AWKWARD.search(t) is not None or t[:1].isspace() or t[-1:].isspace() for t in texts]
        split = [None if o else t.split(" ") for t, o in zip(texts, odd)]
        self._fill(self.cache.wanted(set(chain.from_iterable(p[1:] for p in split if p))))
        heads = self._whole([t if p is None else p[0] for t, p in zip(texts, split)])
        look = self.cache.young.__getitem__
        return [head if p is None else head + b"".join(map(look, p[1:])) for head, p in zip(heads, split)]


@lru_cache(maxsize=4)
def _ranks(data: bytes) -> Ranks:
    return Ranks(data)


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(_ranks(data), pattern)


def _run(docs: DataFrame, path: str, pattern: str, text: str, new: list[T.StructField], both: bool) -> DataFrame:
    kept = [n for n in docs.columns if n not in {f.name for f in new}]
    data, names = docs.sparkSession.sparkContext.broadcast(read_ranks(path)), [*kept, *[f.name for f in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        for whole in batches:
            for batch in text_slices(whole, whole.num_columns - 1, SLICE):
                found = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = np.frombuffer(b"".join(found), dtype="<i4")
                columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
                if both:
                    columns.append(pa.array(decoded(found, encoder.ranks), pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    schema = T.StructType([*[docs.schema[n] for n in kept], *new])
    whole = "_whole"  # an input column may have any name
    while whole in {n.lower() for n in kept}:
        whole += "_"
    return docs.select(*[F.col(f"`{n}`") for n in kept], text_of(text).alias(whole)).mapInArrow(run, schema)


def decoded(found: list[bytes], ranks: Ranks) -> list[bytes]:
    """The bytes that each list of ids (little-endian 32-bit) stands for; an unknown id fails."""
    look = ranks.tokens.__getitem__
    return [b"".join(map(look, np.frombuffer(ids, dtype="<i4").tolist())) for ids in found]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns and ``name``, the ids of the whole text; NULL and empty texts have none.

    The rank file (under 2 MB) is read on the driver and sent to the workers.
    ``name`` takes the place of a column of that name.
    """
    return _run(docs, path, pattern, text, [T.StructField(name, T.ArrayType(T.IntegerType()), False)], False)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
                      name: str = "decoded") -> DataFrame:
    """``encode``, and ``name``: the bytes that ``decode`` makes of the ids, in the same pass."""
    return _run(docs, path, pattern, text, [T.StructField(ids, T.ArrayType(T.IntegerType()), False),
                                            T.StructField(name, T.BinaryType(), False)], True)


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``, the bytes that the ids stand for; NULL ids give none, unknown ids fail."""
    rows = rows.drop(name)
    data = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    names, column = [*rows.columns, name], rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(data.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                found = [np.array(v or [], dtype="<i4").tobytes() for v in batch.column(column).to_pylist()]
                out = pa.array(decoded(found, ranks), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType(), False)])
    return rows.mapInArrow(run, schema)
