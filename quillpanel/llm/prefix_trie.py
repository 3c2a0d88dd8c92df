"""A trie of conversations that borrow their first turns, from fingerprints that compose.

A sequence of turns is an element of a monoid: its length and four sums of
``turn * base^place`` modulo 2^31 - 1, one base each.  Two elements compose as
(n, x) (m, y) = (n + m, x + base^n y), and what follows a prefix is found by
subtraction, so the fingerprint of any prefix of a rebuilt conversation is put
together from the products of its base's head and of its own turns: no rebuilt
text is ever made.  Products come from one sorted pass; a conversation that the
sort cut into slices gets the product of the slices before it composed in front.

Rows with one depth and fingerprint are a node.  That it is one sequence is
verified, not assumed: turns of one digest must have one text, and all rows of a
node one parent and one last turn.  Otherwise other bases are tried.

A node belongs to its smallest member.  Along a conversation the smallest member
only grows, so the nodes that belong to a conversation are the lower end of its
path, and a sum over a node's subtree is the rest of its owner's end and the whole
ends of its other members: two aggregations, at any depth.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_array, bitmap_test, bits_for, repeated_cells, stored

PRIME, LANES = (1 << 31) - 1, 4
#: Depths that one window of subtree sums spans, ids hashed at a time, cells of the bitmap of repeated digests (16 MB), tries.
DEPTHS, IDS, CELLS, TRIES = 1 << 16, 8_192, 1 << 27, 5
NODE = ["depth", "k1", "k2"]


def bases(seed: int) -> list[int]:
    return [random.Random(seed * LANES + i).randrange(1 << 20, PRIME - 1) for i in range(LANES)]


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo the prime."""
    out, square, left = np.ones(len(exponents), dtype=np.int64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def compose(first: tuple, second: tuple, base: list[int]) -> tuple:
    """The product of two elements (length, one sum a lane)."""
    (n, x), (m, y) = first, second
    return n + m, [(a + pow(b, n, PRIME) * c) % PRIME for a, b, c in zip(x, base, y)]


def _digest(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), F.length("role"), "role", "text") for i in (0, 1)]


def _lanes(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(LANES)]


def _products(rows: DataFrame, base: list[int]) -> DataFrame:
    """conv, slice, pos, products after (h) and before (g) each turn, within the slice; rows come sorted by conversation."""
    names = ["conv", "slice", "pos", *_lanes("h"), *_lanes("g"), "a", "b", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, length, held = None, 0, [0] * LANES
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, a, b = (batch.column(i).to_numpy() for i in (0, 2, 3))
            start = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            sizes = np.diff([*start, len(conv)])
            carried = np.zeros(len(start), dtype=np.int64)
            if last == conv[0]:
                carried[0] = length
            pos = np.arange(len(conv)) - np.repeat(start - carried, sizes)
            after, before = [], []
            for lane, value in enumerate((a, a >> 31, b, b >> 31)):
                term = (value & PRIME) * powers(base[lane], pos) % PRIME
                total = np.cumsum(term)
                ahead = total[start] - term[start]
                if last == conv[0]:
                    ahead[0] -= held[lane]
                after.append((total - np.repeat(ahead, sizes)) % PRIME)
                before.append((after[-1] - term) % PRIME)
            last, length, held = conv[-1], int(pos[-1]) + 1, [int(x[-1]) for x in after]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (pos, *after, *before)),
                                              *batch.columns[2:]], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _offsets(local: DataFrame, base: list[int]) -> list[tuple]:
    """(conv, slice, length, product, base^length) of what precedes a slice, for conversations that the sort cut.

    A slice begins inside at most one conversation, so there are fewer rows than slices.
    """
    cut = local.groupBy("conv").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi")).where("lo < hi").select("conv")
    rows = local.join(F.broadcast(cut), "conv").groupBy("conv", "slice").agg(
        (F.max("pos") + 1).alias("n"), F.max_by(F.array(*_lanes("h")), "pos").alias("h")).collect()
    out, conv, so_far = [], None, (0, [0] * LANES)
    for r in sorted(rows, key=lambda r: (r.conv, r.slice)):
        if r.conv != conv:
            conv, so_far = r.conv, (0, [0] * LANES)
        else:
            out.append((conv, r.slice, so_far[0], so_far[1], [pow(b, so_far[0], PRIME) for b in base]))
        so_far = compose(so_far, (r.n, r.h), base)
    return out


def _one_text_each(plain: DataFrame, local: DataFrame, seed: int) -> bool:
    """Whether turns of one digest have one role and text; only digests that may repeat are compared."""
    bits = bits_for(local.count(), 16, CELLS)
    held = plain.sparkSession.sparkContext.broadcast(bitmap_array(repeated_cells(local, "a", bits), bits))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(bitmap_test(held.value, keys.to_numpy()))

    a, b = _digest(seed)
    turn = F.struct("role", "text")
    return plain.where(maybe(a)).groupBy(a.alias("a"), b.alias("b")).agg(
        F.min(turn).alias("x"), F.max(turn).alias("y")).where("x <> y").isEmpty()


def turn_products(plain: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(slices, turns): the stored pass over sorted turns, and every turn's place and products in its conversation."""
    base = bases(seed)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    # Without the tie a turn that many rows repeat could not be cut.
    ranged = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    a, b = _digest(seed)
    local = stored(_products(ranged.select("conv", F.spark_partition_id().cast("long").alias("slice"), a.alias("a"), b.alias("b"),
                                           F.length("text").cast("long").alias("chars")), base))
    ahead = local.sparkSession.createDataFrame(_offsets(local, base),
                                               "conv long, slice long, n long, x array<long>, w array<long>")
    joined = local.join(F.broadcast(ahead), ["conv", "slice"], "left")
    moved = [F.when(F.col("n").isNull(), F.col(c)).otherwise((F.col("x")[i % LANES] + F.col("w")[i % LANES] * F.col(c)) % PRIME)
             .alias(c) for i, c in enumerate([*_lanes("h"), *_lanes("g")])]
    return local, joined.select("conv", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), *moved, "a", "b", "chars")


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])]


def paths(turns: DataFrame, seed: int, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, paths): length of every rebuilt conversation, and a row for each of its prefixes.

    A path row has the keys of its node and of its parent, and the last turn: its
    digest, its code points and where it is stored (``turn_conv``, ``turn_pos``).
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    at_cut = [F.max(F.when(F.col("pos") == h, F.col(f"g{i}"))).alias(f"c{i}") for i in range(LANES)]
    own = turns.groupBy("conv").agg((F.max("pos") + 1).alias("n"), *at_cut).withColumns(
        {"h": h, "base": F.col("conv") - F.col("conv") % block})
    turn = F.struct("pos", F.array(*_lanes("h")).alias("h"), F.array(*_lanes("g")).alias("g"), "a", "b", "chars")
    head = turns.where((F.col("conv") % block == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(turn)).alias("head"))
    none = F.expr("filter(array(struct(0L AS pos, array(0L) AS h, array(0L) AS g, 0L AS a, 0L AS b, 0L AS chars)), x -> false)")
    convs = own.join(head, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
    borrowed = F.size("head").cast("long")
    convs = convs.withColumn("borrowed", borrowed)
    convs = stored(convs.withColumn("len", F.col("borrowed") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))

    back = [F.array(*[F.lit(pow(b, -k, PRIME)) for k in range(heads)]) for b in bases(seed)]
    before = [F.when(F.col("borrowed") > 0, F.element_at("head", -1)["h"][i]).otherwise(F.lit(0)) for i in range(LANES)]
    shift = [f[(F.col("h") - F.col("borrowed")).cast("int")] for f in back]

    def key(prefix: str) -> list[Column]:
        return _packed([(before[i] + shift[i] * F.pmod(F.col(f"{prefix}{i}") - F.col(f"c{i}"), F.lit(PRIME))) % PRIME
                        for i in range(LANES)])

    def named(columns: list[Column], prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{i + 1}") for i, c in enumerate(columns)]

    later = turns.join(convs.drop("base", "n"), "conv").where(F.col("pos") >= F.col("h")).select(
        "conv", "len", (F.col("borrowed") + F.col("pos") - F.col("h") + 1).alias("depth"), *named(key("h"), "k"),
        *named(key("g"), "p"), "a", "b", "chars", F.col("conv").alias("turn_conv"), F.col("pos").alias("turn_pos"))
    t = F.col("t")
    first = convs.select("conv", "len", "base", F.explode("head").alias("t")).select(
        "conv", "len", (t["pos"] + 1).alias("depth"), *named(_packed([t["h"][i] for i in range(LANES)]), "k"),
        *named(_packed([t["g"][i] for i in range(LANES)]), "p"), t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars"),
        F.col("base").alias("turn_conv"), t["pos"].alias("turn_pos"))
    return convs, stored(later.unionByName(first))


def _nodes(path: DataFrame) -> tuple[DataFrame, bool]:
    """Every node below the root, and whether all its rows have one parent and one last turn."""
    same = ["p1", "p2", "a", "b"]
    nodes = stored(path.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("longest"),
        F.max("chars").alias("chars"), *[F.min(c).alias(f"lo_{c}") for c in same], *[F.max(c).alias(f"hi_{c}") for c in same]))
    split = " OR ".join(f"lo_{c} <> hi_{c}" for c in same)
    return nodes.select(*NODE, "owner", "n_convs", "longest", "chars"), nodes.where(split).isEmpty()


def ends_hashes(members: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256: the ids of each node's members that end there, ascending and joined by commas.

    Sorted ids are joined in the tasks that hold them, ``IDS`` at a time, and the
    joined runs of a node are hashed in order, one after the other.
    """
    keyed = members.select(*NODE, "conv")
    ordered = keyed.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, IDS):
                part = batch.slice(a, IDS)
                keys = np.stack([part.column(i).to_numpy() for i in range(3)])
                conv = part.column(3).to_numpy().tolist()
                start = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
                texts = [",".join(map(str, conv[x:y])) for x, y in zip(start, [*start[1:], len(conv)])]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(start)) for c in part.columns], pa.array(texts)],
                                                 names=[*NODE, "first", "ids"])

    schema = "depth long, k1 long, k2 long, first long, ids string"
    joined = ordered.mapInArrow(runs, schema).repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if out:
                yield _hashed(out)
                out = []
        if node is not None:
            yield _hashed([(*node, state.hexdigest())])

    return joined.mapInArrow(hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*NODE, "ends_sha256"])


def _owned(seen: DataFrame) -> DataFrame:
    """Rows of the path that belong to its own conversation, with sums over the rest of that path."""
    rows = seen.where("owner = conv").withColumn("part", F.floor(F.col("depth") / DEPTHS))
    inside = Window.partitionBy("conv", "part").orderBy(F.desc("depth"))
    beyond = Window.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = parts.select("conv", "part", F.sum("leaf").over(beyond).alias("more_leaf"), F.sum("saved").over(beyond).alias("more_saved"))
    summed = rows.withColumns({"leaves": F.sum("leaf").over(inside), "tokens": F.sum("saved").over(inside)})
    return summed.join(later.where("more_leaf IS NOT NULL"), ["conv", "part"], "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("more_leaf", F.lit(0)), "tokens": F.col("tokens") + F.coalesce("more_saved", F.lit(0))})


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                block: int = 100, heads: int = 6) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, all columns whole numbers but the hash.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the stored turn that ends the node:
    turn_conv, turn_pos (NULL for the root).

    Conversation c becomes the first h turns of conversation ``c - c % block``
    (as SQL's %, which keeps the sign) and its own turns after its first h, with
    ``h = crc32(decimal c) % heads``.  Turns are ordered by ``turn``, NULL first,
    then role and text; repeated rows are turns of their own.  NULL role and text
    are empty; rows with a NULL id take no part, and other columns are not read.  An
    empty table has no conversations and gives no rows, not even a root.
    """
    named = F.col(f"`{id_col}`").cast("bigint")
    plain = rows.where(named.isNotNull()).select(
        named.alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    for seed in range(TRIES):
        local, turns = turn_products(plain, seed)
        if not _one_text_each(plain, local, seed):
            continue
        convs, path = paths(turns, seed, block, heads)
        nodes, verified = _nodes(path)
        if verified:
            return _assembled(convs, path, nodes)
    raise RuntimeError(f"fingerprints collided with {TRIES} choices of bases")


def _assembled(convs: DataFrame, path: DataFrame, nodes: DataFrame) -> DataFrame:
    mine = F.col("owner") == F.col("conv")
    seen = stored(path.drop("p1", "p2", "a", "b", "chars").join(nodes, NODE).withColumns({
        "leaf": F.when(mine & (F.col("longest") == F.col("depth")), 1).otherwise(0).cast("long"),
        "saved": F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(F.lit(0))}))
    # Where a conversation's own nodes begin, the owner of the node above them, and sums over its own nodes.
    tails = stored(seen.groupBy("conv").agg(
        F.min(F.when(mine, F.col("depth"))).alias("top"), F.max(F.when(~mine, F.col("owner"))).alias("above"),
        F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved")).where("top IS NOT NULL"))
    borne = seen.where(~mine).select(*NODE, "conv").join(tails, "conv").groupBy(*NODE).agg(
        F.sum("all_leaf").alias("b_leaf"), F.sum("all_saved").alias("b_saved"),
        F.sum((F.col("top") == F.col("depth") + 1).cast("long")).alias("b_children"))
    whole = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).first()
    zero = F.lit(0)
    below = _owned(seen).join(borne, NODE, "left").join(tails.select("conv", "top", "above"), "conv").select(
        *NODE, F.col("conv").alias("conv_id"),
        F.when(F.col("top") < F.col("depth"), F.col("conv")).when(F.col("depth") == 1, F.lit(whole["conv"]).cast("long"))
        .otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        ((F.col("len") > F.col("depth")).cast("long") + F.coalesce("b_children", zero)).alias("n_children"),
        (F.col("leaves") + F.coalesce("b_leaf", zero)).alias("n_leaves"),
        (F.col("tokens") + F.coalesce("b_saved", zero)).alias("saved_tokens"), "turn_conv", "turn_pos")
    children = F.count(F.when(F.col("top") == 1, 1))
    root = tails.agg(children.alias("n_children"), F.greatest(F.coalesce(F.sum("all_leaf"), zero), F.lit(1)).alias("n_leaves"),
                     F.coalesce(F.sum("all_saved"), zero).alias("saved_tokens")).select(
        *[F.lit(0).cast("long").alias(n) for n in NODE], F.lit(whole["conv"]).cast("long").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n_convs"]).cast("long").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.lit(None).cast("long").alias("turn_conv"), F.lit(None).cast("long").alias("turn_pos")).where(
        F.col("n_convs") > 0)
    turnless = convs.where("len = 0").select(*[F.lit(0).cast("long").alias(n) for n in NODE], "conv")
    ends = ends_hashes(path.where("depth = len").select(*NODE, "conv").unionByName(turnless))
    return below.unionByName(root).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "turn_conv", "turn_pos")
