"""Byte-level BPE of a tokenizer file: texts to ids by its list of merges, and ids back to text.

A word of the split pattern is a row of symbols.  The leaves of its segment tree
are its adjacent pairs, each with the rank of the merge that joins it, so the
root is the leftmost pair of least rank.  Joining it changes the pair itself, the
pair to its left and the pair to its right, which vanishes: three leaves and the
nodes above them.  Short words share the levels of one forest and advance
together, a merge each at a time; a long word has a tree of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .common import TwoGenerations, text_of, text_slices

#: Leaf of a pair that no merge joins.
NEVER = 1 << 62
#: Words that a worker remembers, leaves of one forest, the longest word in a forest, bytes of text and words at a time.
CACHE, FOREST, SHARED, SLICE, WORDS = 350_000, 1 << 18, 64, 4 << 20, 1 << 17
#: Fixed value: the split of byte-level models into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between two characters that are not white space.
AMID = regex.compile(r"(?<=\S) (?=\S)")
#: Below this character the classes of the pattern are the same in every version of Unicode (a test asks the library).
SETTLED = "԰"


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies show for each byte: itself where printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """The tables of a tokenizer file: bytes of each id, pairs that may be joined, and the markers taken whole."""

    def __init__(self, data: str):
        file = json.loads(data)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not file.get("normalizer") and before.get("type") == "ByteLevel"
                 and not before.get("add_prefix_space") and before.get("use_regex", True)
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        added = file.get("added_tokens") or []
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only plain byte-level BPE files are read")
        shown = byte_characters()
        value = {c: b for b, c in enumerate(shown)}
        names = {**{i: t for t, i in model["vocab"].items()}, **{t["id"]: t["content"] for t in added}}
        self.bytes = {i: bytes(map(value.__getitem__, t)) if all(c in value for c in t) else t.encode()
                      for i, t in names.items()}
        self.markers = {t["content"]: t["id"] for t in added if t["content"]}
        ids = model["vocab"]
        self.of_byte = np.array([ids[c] for c in shown], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        table = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.rank_of = table
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.keys = np.array([*sorted(table), NEVER], dtype=np.int64)
        self.ranks = np.array([*(table[k] for k in sorted(table)), NEVER], dtype=np.int64)
        two = self.of_byte[:, None] << 32 | self.of_byte[None, :]
        self.of_two_bytes = self.joins(two.ravel())

    def joins(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair (left id in the upper 32 bits), ``NEVER`` where there is none."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)


def lone_tree(word: bytes, merges: Merges) -> bytes:
    """Ids (little-endian 32-bit) of one word, by a segment tree of its own."""
    n = len(word)
    symbols = merges.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
    width = 1 << max(0, n - 2).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    level = merges.joins(np.array(symbols[:-1], dtype=np.int64) << 32 | np.array(symbols[1:], dtype=np.int64))
    level = np.concatenate([np.where(level < NEVER, level * n + np.arange(n - 1), NEVER),
                            np.full(width - n + 1, NEVER, dtype=np.int64)])
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[0::2], level[1::2])
        levels.append(level)
    tree = list(chain.from_iterable(lv.tolist() for lv in reversed(levels)))  # node i has the children 2i + 1 and 2i + 2
    first, rank_of, made = width - 1, merges.rank_of, merges.made.tolist()

    def update(leaf: int, left: int, right: int) -> None:
        rank = rank_of.get(symbols[left] << 32 | symbols[right]) if right < n else None
        put(leaf, NEVER if rank is None else rank * n + leaf)

    def put(leaf: int, key: int) -> None:
        node = first + leaf
        tree[node] = key
        while node:
            node = (node - 1) >> 1
            a, b = tree[2 * node + 1], tree[2 * node + 2]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least

    while tree[0] < NEVER:
        rank, at = divmod(tree[0], n)
        gone = after[at]
        beyond = after[gone]
        symbols[at], symbols[gone], after[at] = made[rank], -1, beyond
        if gone < n - 1:
            put(gone, NEVER)
        if beyond < n:
            before[beyond] = at
        update(at, at, beyond)
        if before[at] >= 0:
            update(before[at], before[at], at)
    kept = np.array(symbols, dtype=np.int64)
    return kept[kept >= 0].astype("<i4").tobytes()


def forest(words: list[bytes], width: int, merges: Merges) -> list[bytes]:
    """Ids of words of at most ``width`` bytes (a power of two); row r of every level is word r's.

    Leaf i is the pair that starts at byte i; ``width`` is the position after the last.
    """
    count, bits = len(words), width.bit_length() - 1
    length = np.fromiter(map(len, words), dtype=np.int64, count=count)[:, None]
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(count, width).astype(np.int64)
    place = np.arange(width)[None, :]
    symbols = np.full((count, width + 1), -1, dtype=np.int64)
    symbols[:, :width] = np.where(place < length, merges.of_byte[raw], -1)
    after = np.where(place + 1 < length, place + 1, width)
    before = np.repeat(np.concatenate([[width], np.arange(width)])[None, :], count, axis=0)
    leaf = np.full((count, width), NEVER, dtype=np.int64)
    rank = merges.of_two_bytes[raw[:, :-1] << 8 | raw[:, 1:]]
    leaf[:, :-1] = np.where((place[:, 1:] < length) & (rank < NEVER), rank << bits | place[:, :-1], NEVER)
    levels = [leaf]
    for _ in range(bits):
        levels.append(np.minimum(levels[-1][:, 0::2], levels[-1][:, 1::2]))

    def refresh(rows: np.ndarray, at: np.ndarray) -> None:
        for lower, upper in zip(levels, levels[1:]):
            at = at >> 1
            upper[rows, at] = np.minimum(lower[rows, 2 * at], lower[rows, 2 * at + 1])

    def renew(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        found = merges.joins(np.where(right < width, symbols[rows, left] << 32 | symbols[rows, right], -1))
        leaf[rows, left] = np.where(found < NEVER, found << bits | left, NEVER)

    rows = np.flatnonzero(levels[-1][:, 0] < NEVER)
    while len(rows):
        root = levels[-1][rows, 0]
        at, rank = root & (width - 1), root >> bits
        gone = after[rows, at]
        beyond = after[rows, gone]
        symbols[rows, at], symbols[rows, gone] = merges.made[rank], -1
        after[rows, at], before[rows, beyond] = beyond, at
        leaf[rows, gone] = NEVER
        renew(rows, at, beyond)
        lead = before[rows, at]
        has = np.flatnonzero(lead < width)
        renew(rows[has], lead[has], at[has])
        refresh(np.concatenate([rows, rows, rows[has]]), np.concatenate([at, gone, lead[has]]))
        rows = rows[levels[-1][rows, 0] < NEVER]

    kept = symbols[:, :width]
    alive = kept >= 0
    flat, ends = kept[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def word_ids(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word: short words of like length in forests, long ones alone."""
    out = [b""] * len(words)
    alike: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) == 1:
            out[i] = int(merges.of_byte[word[0]]).to_bytes(4, "little")
        elif len(word) > SHARED:
            out[i] = lone_tree(word, merges)
        elif word:
            alike.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
    for width, members in alike.items():
        step = FOREST // width
        for a in range(0, len(members), step):
            part = members[a:a + step]
            for i, ids in zip(part, forest([words[i] for i in part], width, merges)):
                out[i] = ids
    return out


class Model:
    """Encodes and decodes with one tokenizer file, remembering words between calls."""

    def __init__(self, data: str):
        self.merges, self.known = Merges(data), TwoGenerations(CACHE)
        self.split = regex.compile(SPLIT)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        # Longer markers first: of markers that start at one place, the longest is taken.
        marks = sorted(self.merges.markers, key=len, reverse=True)
        self.marked = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without markers, in lists of bounded size."""
        if not text:
            return
        if not text.isascii() and max(text) >= SETTLED:  # classes differ between versions of Unicode: the library decides
            for part in _segments(text):
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        elif len(text) <= SLICE:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while block := list(islice(found, WORDS)):
                yield block

    def _learn(self, wanted: set[str]) -> None:
        for part in _blocks(list(self.known.wanted(wanted)), WORDS):
            self.known.young.update(zip(part, word_ids([w.encode() for w in part], self.merges)))

    def _plain(self, texts: list[str]) -> list[bytes]:
        short = [list(chain.from_iterable(self._words(t))) if len(t) <= SLICE else None for t in texts]
        self._learn(set(chain.from_iterable(s for s in short if s)))
        look = self.known.young
        out = [b"".join(map(look.__getitem__, s)) if s is not None else b"" for s in short]
        for i, s in enumerate(short):
            if s is None:
                parts = []
                for block in self._words(texts[i]):
                    self._learn(set(block))
                    parts.append(b"".join(map(self.known.young.__getitem__, block)))
                out[i] = b"".join(parts)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; markers are ids of their own, what lies between is split alone."""
        if self.marked is None:
            return self._plain(texts)
        parts = [self.marked.split(t) if any(m in t for m in self.merges.markers) else (t,) for t in texts]
        between = iter(self._plain([p for split in parts for p in split[::2]]))
        ids = {m: i.to_bytes(4, "little") for m, i in self.merges.markers.items()}
        return [b"".join(ids[p] if k % 2 else next(between) for k, p in enumerate(split)) for split in parts]

    def decode(self, ids: list[int]) -> str:
        """The text that the ids stand for; ids without a token are left out, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.merges.bytes.get, filter(self.merges.bytes.__contains__, ids))).decode("utf-8", "replace")


def _segments(text: str, size: int = SLICE) -> Iterator[str]:
    """The text cut before blanks between two other characters, where a word always starts; about ``size`` characters each."""
    start = 0
    while len(text) - start > size:
        cut = AMID.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _blocks(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a:a + size]


@lru_cache(maxsize=2)
def _model(data: str) -> Model:
    return Model(data)


def _held(rows: DataFrame, path: str):
    """The tokenizer file (under 2 MB) for the workers."""
    with open(path, encoding="utf-8") as file:
        data = file.read()
    Merges(data)  # a file that cannot be read is an error here, not in a task
    return rows.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns and ``ids``: the ids of the whole text, as the file's own library gives without special tokens.

    NULL and empty texts have no ids.  With ``decoded`` that column holds what
    ``decode`` makes of the ids, in the same pass.  The new columns take the
    place of columns of those names; rows are kept as they are, repeats too.
    """
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()), False),
           *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    kept = [n for n in docs.columns if n not in {f.name for f in new}]
    names, data = [*kept, *(f.name for f in new)], _held(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for whole in batches:
            for batch in text_slices(whole, whole.num_columns - 1, SLICE):
                found = model.encode(batch.column(batch.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = np.frombuffer(b"".join(found), dtype="<i4")
                columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([model.decode(np.frombuffer(f, dtype="<i4").tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    schema = T.StructType([*[docs.schema[n] for n in kept], *new])
    whole = "_whole"  # an input column may have any name
    while whole in {n.lower() for n in kept}:
        whole += "_"
    return docs.select(*[F.col(f"`{n}`") for n in kept], text_of(text).alias(whole)).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``: the text of the ids; NULL ids give an empty one."""
    rows = rows.drop(name)
    data, names, column = _held(rows, path), [*rows.columns, name], rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                out = [model.decode([i for i in v or [] if i is not None]) for v in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType(), False)]))
