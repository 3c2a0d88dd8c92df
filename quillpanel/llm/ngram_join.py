"""Documents linked by the Jaccard similarity of their word n-grams.

1. Each document becomes the sorted set of its n-gram hashes.  Documents with the
   same set are one class.
2. Candidates.  Two sets that are similar enough differ in at most ``k`` n-grams,
   ``k`` following from their sizes.  The n-gram space is cut into more than ``k``
   parts by hash, so at least one part is the same in both: classes that share a
   part's content, within a range of sizes, are candidates.  N-grams of common
   passages are left out of the parts where a set has enough others.  Contents meet
   in buckets of about one size, a fixed share of the buckets at a time, so what is
   moved and on disk at once is a fixed share of the contents, however many there are.
3. Candidates that hang together form a block, and each block is a sparse matrix
   product: its incidence matrix (documents by n-grams) times its transpose is
   summed over runs of n-gram columns, pairs whose sizes cannot reach the
   threshold are masked, and the exact test is made on the counts.
4. A block larger than one task may hold is cut into sub-blocks.  Each is
   multiplied by itself; then one member of each of their components; what is by
   then in the block's largest component needs no further comparing with itself,
   and only the others are multiplied by every sub-block.  Every pair that could
   link two components is therefore tested, without testing all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import passing_table
from .common import (TwoGenerations, arrow_rows, bitmap_array, bitmap_test, bits_for, give_back, releasing,
                     repeated_cells, stored, text_of, text_slices, texts_in, without, words_of)
from .components import components

#: Most n-grams and documents of one product, columns multiplied at a time, and most cells of a bitmap (16 MB).
BLOCK_GRAMS, BLOCK_DOCS, COLUMNS, MOST_CELLS = 1_500_000, 2_000, 1_024, 1 << 27
WORDS = 150_000
#: Rows of a product that are tested at a time.
ROWS = 128
#: N-grams that a part needs for its content to be no coincidence, such as one n-gram of a common passage.
STRONG = 2
#: Documents of a slice that make an n-gram common, and cells of the bitmap of common ones (4 MB).
COMMON, COMMON_CELLS = 4, 1 << 25
#: Parts that meet in one task, about, least number of such buckets, and turns in which they are taken: only the parts
#: of one turn are moved at a time.
BUCKET_PARTS, LEAST_BUCKETS, TURNS = 1_000_000, 256, 4
#: Odd multipliers of the n-gram hash.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Rule:
    """Linked if intersection / union >= num / den, on sets of ``words``-word n-grams."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least_common(self, total):
        """Least intersection of two sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def size_classes(self, largest: int) -> list[int]:
        """Lower ends of size classes; a set links only within its class and the next ones above and below."""
        ends = [1]
        while ends[-1] <= largest:
            ends.append(ends[-1] * self.den // self.num + 1)
        return ends

    def parts(self, lower: int, upper: int) -> tuple[int, int]:
        """(parts, spare) for pairs whose smaller set has ``lower`` to ``upper - 1`` n-grams.

        Such a pair differs in at most parts - 1 - spare n-grams, so it agrees
        in at least spare + 1 parts.  There are more spare ones the more parts
        of a set are expected to hold fewer than ``STRONG`` n-grams.
        """
        small = upper - 1
        total = small + small * self.den // self.num
        many = total - 2 * self.least_common(total) + 1
        spare = 0 if many <= 3 else 1 if many <= 10 else 2
        while many > 3 and spare < many:
            mean = 0.8 * lower / (many + spare)  # a fifth of a set may be common n-grams, which are left out
            if 1.2 * (many + spare) * math.exp(-mean) * (1 + mean) + 1 <= spare:
                break
            spare += 1
        return many + spare, spare


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * MIX[1]
    return values ^ values >> np.uint64(29)


class Shingler:
    """Sorted distinct n-gram hashes of texts; a worker remembers the hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, TwoGenerations(WORDS)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        wanted = self.known.wanted(set().union(*split) if split else set())
        self.known.young.update((w, xxhash.xxh3_64_intdigest(w)) for w in wanted)
        look, out = self.known.young.__getitem__, []
        for words in split:
            hashes = np.fromiter(map(look, words), dtype=np.uint64, count=len(words))
            many = min(self.words, len(words))
            if not many:
                out.append(hashes)
                continue
            grams = np.full(len(words) - many + 1, many, dtype=np.uint64)
            for i in range(many):
                grams = mixed(grams * MIX[0] + hashes[i:len(words) - many + 1 + i])
            out.append(np.unique(grams))
        return out


def _content(grams: np.ndarray, many: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, sizes, identifiers) of the parts that hold any of the sorted n-grams."""
    part = ((grams >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    key = np.uint64(salt << 32) + part[starts].astype(np.uint64)
    return part[starts], np.diff(starts, append=len(part)), mixed(
        np.add.reduceat(mixed(grams * MIX[2]), starts) + mixed(key * MIX[0]))


def signatures(grams: np.ndarray, common: np.ndarray, rule: Rule, ends: list[int], rules: dict) -> np.ndarray:
    """Identifiers of the set's parts, for its own size class and the one below.

    ``common`` marks n-grams that are left out where possible (any choice is
    right as long as it is the same for all sets).  Without them, too, a linked
    set agrees in at least spare + 1 parts, so one of them is strong unless more
    than ``spare`` parts are weak.  A set with more weak parts also gives its parts
    with common n-grams, and with those all parts, should too many be weak again.
    A linked pair has either one set with few weak parts, or two of the other kind.
    The lowest bit of an identifier says which of the set's two classes it is for.
    """
    own = int(np.searchsorted(ends, len(grams), side="right")) - 1
    rare, out = grams[~common], []

    def add(found: np.ndarray) -> None:
        out.append(found >> np.uint64(1) << np.uint64(1) | np.uint64(group & 1))

    for group in (own - 1, own):
        if group < 0:
            continue
        if group not in rules:
            rules[group] = rule.parts(ends[group], ends[group + 1])
        many, spare = rules[group]
        strong_parts = 0
        if len(rare):
            _, size, found = _content(rare, many, 2 * group)
            add(found[size >= STRONG])
            strong_parts = len(out[-1])
        if many - strong_parts <= spare:
            continue
        part, size, found = _content(grams, many, 2 * group + 1)
        strong = size >= STRONG
        if many - strong.sum() <= spare:
            add(found[strong])
            continue
        missing = np.setdiff1d(np.arange(many), part).astype(np.uint64)
        add(found)
        add(mixed(mixed((np.uint64(group << 32) + missing) * MIX[0]) + np.uint64(1)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def overlaps(grams: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """Counts of common n-grams of all pairs in a block, summed over runs of ``COLUMNS`` n-grams."""
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    counts = np.zeros((many, many), dtype=np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        rows, at = np.unique(owner[a:b], return_inverse=True)
        incidence = np.zeros((len(rows), min(COLUMNS, last - first)), dtype=np.float32)
        incidence[at, column[a:b] - first] = 1
        counts[np.ix_(rows, rows)] += incidence @ incidence.T
    return counts


def linked(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Boolean matrix of links between the sets of a block, tested for some rows at a time."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    counts = overlaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
    out = np.empty(counts.shape, dtype=bool)
    for first in range(0, len(sets), ROWS):
        own, common = sizes[first:first + ROWS, None], counts[first:first + ROWS].astype(np.int64)
        possible = (rule.den * own >= rule.num * sizes) & (rule.den * sizes >= rule.num * own)
        out[first:first + ROWS] = possible & (rule.den * common >= rule.num * (own + sizes - common))
    return out


def labels_of(links: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(len(links))
    while True:
        least = np.concatenate([np.where(links[i:i + ROWS], label, len(links)).min(axis=1)
                                for i in range(0, len(links), ROWS)])
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _products(members: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links that span the components of each block; ``members`` has block, comp, cls and grams.

    Small blocks share a task's frame: pairs are tested within one ``comp``.  Each
    member that is linked is paired with the smallest one of its component there.
    """

    def run(frame: pa.Table) -> pa.Table:
        left, right = [], []
        comp, cls, grams = (frame.column(n).combine_chunks() for n in ("comp", "cls", "grams"))
        comp = comp.to_numpy(zero_copy_only=False)
        order = np.argsort(comp, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(part) < 2:
                continue
            sets = [np.frombuffer(grams[i].as_buffer(), dtype=np.uint64) for i in part.tolist()]
            label = labels_of(linked(sets, rule))
            linked_ones = np.flatnonzero(label != np.arange(len(label)))
            left.extend(cls[i].as_py() for i in part[linked_ones].tolist())
            right.extend(cls[i].as_py() for i in part[label[linked_ones]].tolist())
        del comp, cls, grams, frame
        give_back()
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return members.select("block", "comp", "cls", "grams").groupBy("block").applyInArrow(run, "a binary, b binary")


def common_grams(texts: DataFrame, rule: Rule, most_cells: int) -> np.ndarray:
    """Bitmap of n-grams that several documents of one slice share; only a hint, of ``most_cells`` / 8 bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule.words)
        for whole in batches:
            for batch in text_slices(whole, 1):
                sets = [s for s in shingler.sets(list(texts_in(batch.column(1)))) if len(s)]
                if sets:
                    grams, times = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams[times >= COMMON].view(np.int64))], names=["gram"])

    bits = min(most_cells, COMMON_CELLS)
    with arrow_rows(texts.sparkSession):
        return bitmap_array(repeated_cells(texts.mapInArrow(releasing(run), "gram long"), "gram", bits, 1), bits)


def class_table(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text: str = "text",
                most_cells: int = MOST_CELLS) -> DataFrame:
    """_id, n (set size), cls (128-bit identifier of the set), parts (identifiers of its parts)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("n", T.LongType(), False),
                           T.StructField("cls", T.BinaryType(), False),
                           T.StructField("parts", T.ArrayType(T.LongType(), False), False)])
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(common_grams(texts, rule, most_cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, ends, rules = Shingler(rule.words), rule.size_classes(1 << 40), {}
        for whole in batches:
            for batch in text_slices(whole, 1):
                sets = shingler.sets(list(texts_in(batch.column(1))))
                parts = [signatures(s, bitmap_test(held.value, s.view(np.int64)), rule, ends, rules) if len(s)
                         else np.empty(0, dtype=np.int64) for s in sets]
                stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(parts)))], names=schema.names)

    return texts.mapInArrow(releasing(run), schema)


def nodes_of(cls: str) -> Column:
    """The two 64-bit names of a class; if two classes shared one, they would only be compared needlessly."""
    name = F.xxhash64(cls)
    return F.array(name.bitwiseAND(F.lit(-2)), name.bitwiseOR(F.lit(1)))


def _met(classes: DataFrame, turn: int, buckets: int) -> DataFrame:
    """(node, leader) of classes that share a part: its smallest node is the leader, of itself too.

    Parts are dealt by their highest bits to buckets, of which every ``TURNS``-th
    is looked at; a task sends the parts of a bucket and their nodes as two arrays.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            values = parts.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(parts).to_numpy())
            bucket = ((values.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            mine = np.flatnonzero(bucket % TURNS == turn)
            mine = mine[np.argsort(bucket[mine], kind="stable")]
            values, bucket = values[mine], bucket[mine]
            nodes = batch.column(0).to_numpy()[owner[mine]] & ~1 | values & 1
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts]), *[pa.array([v.tobytes() for v in np.split(a, cuts[1:])][:len(cuts)], pa.binary())
                                           for a in (values, nodes)]], names=["bucket", "parts", "nodes"])

    def meet(group: pa.Table) -> pa.Table:
        parts, nodes = (np.frombuffer(b"".join(group.column(n).to_pylist()), dtype=np.int64) for n in ("parts", "nodes"))
        order = np.argsort(parts)
        parts, nodes = parts[order], nodes[order]
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        least, most = np.minimum.reduceat(nodes, starts), np.maximum.reduceat(nodes, starts)
        many = np.diff(starts, append=len(parts))
        shared = np.repeat(least < most, many)
        give_back()
        return pa.table({"node": nodes[shared], "leader": np.repeat(least, many)[shared]})

    dealt = classes.select(F.xxhash64("cls").alias("node"), "parts").mapInArrow(
        releasing(deal), "bucket long, parts binary, nodes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "node long, leader long").distinct()


def candidate_blocks(classes: DataFrame, bucket_parts: int = BUCKET_PARTS) -> DataFrame:
    """(node, comp) of every class that shares a part with another; ``comp`` names the block.

    A class has a node for each of its two ranges of sizes (``nodes_of``), so
    blocks do not hang together across sizes that cannot be similar.
    """
    rows = classes.agg(F.sum(F.size("parts"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-rows // bucket_parts))
    with arrow_rows(classes.sparkSession):
        led = reduce(DataFrame.unionAll, [stored(_met(classes, turn, buckets)) for turn in range(TURNS)])
    # Every class goes with its smallest leader; what is left to connect is leaders among themselves.
    own = stored(led.groupBy("node").agg(F.min("leader").alias("least")))
    between = led.join(own, "node").where("leader <> least").select("leader", "least")
    joined = components(between, "leader", "least")
    return own.join(joined.withColumnRenamed("node", "least"), "least", "left").select(
        "node", F.coalesce("label", "least").alias("comp"))


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule, id_col: str, text: str, most_cells: int) -> DataFrame:
    """The sets of the wanted classes, read again from one document of each, with all but _id and n of ``wanted``."""
    bits = bits_for(wanted.count(), 16, most_cells)
    chosen = bitmap_array(repeated_cells(wanted.select(F.xxhash64("_id").alias("key")), "key", bits, 1), bits)
    held = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule.words)
        for whole in batches:
            keep = bitmap_test(held.value, whole.column(0).to_numpy())
            for batch in text_slices(whole.filter(pa.array(keep)), 1):
                sets = shingler.sets(list(texts_in(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "grams"])

    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("key"), text_of(text).alias("_text"))
    found = rows.mapInArrow(releasing(run), "cls binary, grams binary")
    return found.dropDuplicates(["cls"]).join(wanted.drop("_id", "n"), "cls")


def class_links(docs: DataFrame, classes: DataFrame, blocks: DataFrame, rule: Rule, id_col: str = "doc_id",
                text: str = "text", most_cells: int = MOST_CELLS, block_grams: int = BLOCK_GRAMS,
                block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(cls, label): components of the links between classes, for classes that have any; ``blocks`` as of
    ``candidate_blocks``."""
    owners = classes.groupBy("cls").agg(F.min("_id").alias("_id"), F.first("n").alias("n"))
    wanted = stored(owners.withColumn("node", F.explode(nodes_of("cls"))).join(blocks, "node").drop("node"))
    sizes = stored(wanted.groupBy("comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams")).select(
        "comp", F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("grams") / block_grams)).alias("cuts")))
    sized = stored(wanted.join(sizes, "comp").withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("cuts"))))
    frames = max(1, 8 * (wanted.agg(F.sum("n")).first()[0] or 0) // block_grams)
    at = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("comp"), F.lit(frames))).otherwise(F.xxhash64("comp"))
    block = F.struct(at.alias("at"), F.when(F.col("cuts") > 1, F.col("sub")).otherwise(-1).alias("sub"))
    with arrow_rows(docs.sparkSession), passing_table(_sets_of(docs, sized, rule, id_col, text, most_cells)) as placed:
        links = stored(_products(placed.withColumn("block", block), rule))
        members = stored(sized.where("cuts > 1").select("cls", "comp"))
        if not members.isEmpty():
            links = _links_of_cut(placed.where("cuts > 1").select("cls", "comp", "grams"), members, links, rule, block_docs)
        return stored(components(links, "a", "b").select(F.col("node").alias("cls"), "label"))


def _links_of_cut(pieces: DataFrame, members: DataFrame, links: DataFrame, rule: Rule, block_docs: int) -> DataFrame:
    """``links`` within the sub-blocks of cut blocks and those across them; ``members`` has pieces' cls and comp."""

    def labelled(links: DataFrame) -> DataFrame:
        inside = components(links, "a", "b").select(F.col("node").alias("cls"), "label")
        return members.join(inside, "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    # One member of each component within a cut block, multiplied with those of its block.
    first = stored(labelled(links).groupBy("comp", "label").agg(F.min("cls").alias("cls")).select("comp", "cls"))
    with passing_table(pieces.join(first, ["comp", "cls"])) as leaders:
        links = stored(links.unionAll(_against(leaders, leaders, rule, block_docs, same=True)))
    now = stored(labelled(links))
    many = now.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("many"))
    core = stored(many.groupBy("comp").agg(F.max_by("label", F.struct("many", "label")).alias("core")))
    rest = stored(now.join(core, "comp").where("label <> core").select("comp", "cls"))
    if rest.isEmpty():
        return links
    with passing_table(pieces.join(rest, ["comp", "cls"])) as others:
        return stored(links.unionAll(_against(others, pieces, rule, block_docs)))


def _against(some: DataFrame, all_: DataFrame, rule: Rule, block_docs: int, same: bool = False) -> DataFrame:
    """Products of cuts of ``some`` with cuts of ``all_``, which holds them too, within each block (comp).

    Both have cls, comp and grams; ``same`` says that they are one table.  In turn t
    the i-th cut meets the (i + t)-th, so a turn moves each row once, and what is
    on disk does not grow with the number of cuts; the products are as many as ever.
    """
    half = max(1, block_docs // 2)

    def cuts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / half).alias(name))

    # A row for each block that was too large for a task, so few that they are sent to all tasks.
    sizes = stored(cuts(some, "is").join(cuts(all_, "js"), "comp"))
    many = sizes.agg(F.max("js")).first()[0] or 0
    cut = F.xxhash64("cls", F.lit(7))
    found = []
    for t in range(many // 2 + 1 if same else many):
        # Of one table, cuts i and i + t meet as those of i + t and i + (js - t) do; each cut is tested with itself too.
        asked = F.lit(t) < F.when(F.lit(same) & (F.col("js") > 1), F.floor(F.col("js") / 2) + 1).otherwise(F.col("js"))
        turn = F.broadcast(sizes.where(asked & ~(F.lit(same) & (F.col("js") > 1)) if t == 0 else asked))
        left = some.join(turn, "comp").withColumn("i", F.pmod(cut, F.col("is"))).withColumn("j", F.pmod(F.col("i") + t, F.col("js")))
        right = all_.join(turn, "comp").withColumn("j", F.pmod(cut, F.col("js"))).withColumn(
            "i", F.pmod(F.col("j") - t, F.col("js"))).where(F.col("i") < F.col("is"))
        both = left.select("comp", "i", "j", "cls", "grams").unionAll(right.select("comp", "i", "j", "cls", "grams"))
        block = F.struct(F.xxhash64("comp").alias("at"), (F.col("i") * F.lit(1 << 31) + F.col("j")).alias("sub"))
        found.append(stored(_products(both.withColumn("block", block), rule)))
    return reduce(DataFrame.unionAll, found)


def linked_documents(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text: str = "text",
                     most_cells: int = MOST_CELLS, block_grams: int = BLOCK_GRAMS,
                     block_docs: int = BLOCK_DOCS) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) of every document.

    Words are lower-cased in A-Z and separated by ASCII white space; a document
    with fewer words than an n-gram has one n-gram, all its words.  Without words
    (NULL, empty or blank text) it links with nothing and is its own component.
    Rows with equal sets are linked.  A NULL id is no candidate for the smallest
    id unless its whole component has none.  Other columns are ignored.
    """
    with arrow_rows(docs.sparkSession), passing_table(class_table(docs, rule, id_col, text, most_cells)) as whole:
        table = stored(whole.drop("parts"))
        blocks = stored(candidate_blocks(whole.where("n > 0")))
    blank = table.where("n = 0").select("_id", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    classes = table.where("n > 0")
    labels = class_links(docs, classes, blocks, rule, id_col, text, most_cells, block_grams, block_docs)
    rows = stored(classes.select("_id", F.col("n").alias("n_shingles"), "cls").join(stored(labels), "cls", "left").select(
        "_id", "n_shingles", F.coalesce("label", "cls").alias("label")))
    smallest = stored(rows.groupBy("label").agg(F.min("_id").alias("component_id")))
    rest = rows.join(smallest, "label").drop("label")
    return blank.unionByName(rest).withColumnRenamed("_id", id_col)


def one_of_each_component(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text: str = "text",
                          most_cells: int = MOST_CELLS) -> DataFrame:
    """The documents that stay, columns as they are: of linked ones that with the smallest id.

    Rows that share an id share its decision; rows with a NULL id stay.
    """
    found = linked_documents(docs, rule, id_col, text, most_cells)
    gone = stored(found.where(F.col(f"`{id_col}`") != F.col("component_id")).select(F.col(f"`{id_col}`")).distinct())
    return without(docs, gone, id_col, most_cells)
