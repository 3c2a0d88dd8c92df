"""Exact duplicates by two passes over a Bloom filter, in DataFrame operations only.

Pass 1 sends each row's two filter cells (8 bytes each, summed before the
shuffle) to find cells hit more than once.  Pass 2 tests every row against that
bitmap: a row with a cell hit once only is certainly alone and passes straight
through; the others, and no one else, are shuffled on their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, lower_az, repeated_cells, stored, text_of

#: Filter cells for each row, and the most cells: 2^27 cells are at most 2^21 broadcast words of 16 bytes.
CELLS_PER_ROW = 32
MOST_CELLS = 1 << 27


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text_sha256`` of the text with A-Z lower-cased (NULL: empty)."""
    return docs.withColumn("text_sha256", F.sha2(lower_az(text_of(text)), 256))


def _probe(seed: int):
    return F.xxhash64(F.col("text_sha256"), F.lit(seed))


def bloom_cells(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: the filter's cells that are hit more than once, as (word, bits)."""
    probes = digests.select(F.explode(F.array(_probe(1), _probe(2))).alias("probe"))
    return repeated_cells(probes, "probe", bits)


def with_maybe_repeated(rows: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """Pass 2: add ``maybe_repeated``, false only for hashes that occur once.

    The bitmap has at most ``bits / 64`` rows, so it is broadcast; a filter that
    is too small for its data sends more rows to the shuffle and loses none.
    """
    out = rows
    for seed in (1, 2):
        cell = F.pmod(_probe(seed), F.lit(bits))
        out = out.withColumn(f"_cell{seed}", cell).join(
            F.broadcast(cells.select(F.col("word").alias(f"_word{seed}"), F.col("bits").alias(f"_bits{seed}"))),
            F.expr(f"shiftright(_cell{seed}, 6) = _word{seed}"), "left")
    hit = [F.expr(f"(shiftright(_bits{s}, cast(_cell{s} & 63 AS int)) & 1) = 1") for s in (1, 2)]
    extra = [f"_{n}{s}" for n in ("cell", "word", "bits") for s in (1, 2)]
    return out.withColumn("maybe_repeated", F.coalesce(hit[0] & hit[1], F.lit(False))).drop(*extra)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id of a group stays.  NULL text counts as empty, a NULL id as
    smaller than any.  Of rows that agree in id and text one stays, the others
    are returned with ``kept`` false.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    digests = stored(with_hash(docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text")), "_text")
                     .drop("_text"))
    bits = bits_for(digests.count(), CELLS_PER_ROW, most_cells)
    tested = with_maybe_repeated(digests, bloom_cells(digests, bits), bits)
    alone = tested.where(~F.col("maybe_repeated")).select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256")
    rows = tested.where("maybe_repeated").groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("copies"))
    # Stored, so that the join can split a hash that very many rows share.
    groups = stored(rows.groupBy("text_sha256").agg(F.max("_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    joined = (rows.join(groups, "text_sha256")
              .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
              .withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)))
    return alone.unionByName(joined.select("_id", "keep_id", "group_size", "kept", "text_sha256")).withColumnRenamed(
        "_id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                          most_cells: int = MOST_CELLS) -> DataFrame:
    """The documents that stay, with their columns as they are.

    Rows that pass the filter as certainly alone are not shuffled; of the others
    the text moves only for one candidate of each group and for filter misses.
    """
    digests = stored(with_hash(docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text")), "_text")
                     .drop("_text"))
    bits = bits_for(digests.count(), CELLS_PER_ROW, most_cells)
    cells = stored(bloom_cells(digests, bits))
    tested = with_maybe_repeated(digests, cells, bits).where("maybe_repeated")
    groups = stored(tested.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("_id").alias("_keep"),
                                                                           F.count(F.lit(1)).alias("_size")))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
                       F.sha2(lower_az(text_of(text)), 256).alias("text_sha256"))
    flagged = with_maybe_repeated(rows, cells, bits)
    alone = flagged.where(~F.col("maybe_repeated"))
    several = flagged.where("maybe_repeated").join(
        groups, (F.col("text_sha256") == F.col("_sha")) & F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_keep")))
    single = several.where("_size = 1")
    one = several.where("_size > 1").groupBy("text_sha256").agg(F.first("_row").alias("_row"))
    out = alone.select("_row").unionByName(single.select("_row")).unionByName(one.select("_row"))
    return out.select("_row.*")
