"""What a step moved or stored for itself is removed with it, and the buckets in which parts meet lose nothing."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quillpanel.catalog import jobs
from quillpanel.llm import ngram_join
from quillpanel.llm.common import bitmap_array, repeated_cells, stored
from quillpanel.operators import cross_section as cs
from quillpanel.operators.panel_features import panel_features
from quillpanel.plans.skew import frozen
from quillpanel.session import checkpoint_dir, passing_table

from .conftest import SMALL


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {os.path.basename(f) for f in found.split("\n") if "shuffle_" in f}


def tables(spark) -> set[str]:
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_stored_tables_leave_no_moved_rows(spark):
    rows = spark.range(5000).withColumn("part", F.xxhash64("id")).groupBy("part").agg(F.max("id").alias("most"))
    before = shuffle_files(spark)
    for table in (frozen(rows), stored(rows)):
        assert table.count() == 5000
    bitmap_array(repeated_cells(rows, "part", 1 << 10), 1 << 10)
    after = {f for f in shuffle_files(spark) - before if os.path.splitext(f)[1] == ".data"}
    assert len(after) <= 2  # the two counts', one row a task
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_passing_table_is_removed(spark):
    before = tables(spark)
    with passing_table(spark.range(10).toDF("x")) as rows:
        assert len(tables(spark) - before) == 1 and rows.count() == 10
    assert tables(spark) == before


def test_parts_meet_in_turns(spark):
    """Every part is looked at in one turn, links are those of one grouped pass, and the table of parts does not stay."""
    parts = [(f"c{i}".encode(), [(i % 7) * 0x0F34567890ABCDE0, (i * 7919 << 40) + 1, -1 - i % 3])
             for i in range(60)]
    classes = spark.createDataFrame(parts, "cls binary, parts array<bigint>")
    node = F.xxhash64("cls").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("part").bitwiseAND(F.lit(1)))
    each = classes.select("cls", F.explode("parts").alias("part")).select("part", node.alias("node"))
    led = each.groupBy("part").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader < most")
    want = {(r.node, r.leader) for r in each.join(led, "part").collect()}
    found = [{(r.node, r.leader) for r in ngram_join._met(classes, turn, 8).collect()} for turn in range(ngram_join.TURNS)]
    assert set().union(*found) == want and sum(map(bool, found)) > 1
    docs = spark.createDataFrame([(i, "one two three four five six " + "x" * (i % 2)) for i in range(6)], "doc_id long, text string")
    before = tables(spark)
    assert {r.component_id for r in ngram_join.linked_documents(docs, ngram_join.Rule()).collect()} == {0, 1}
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    assert not any("parts" in spark.read.parquet(f"{folder}/{t}").columns for t in tables(spark) - before)


def test_cuts_meet_in_turns_that_move_each_row_once(spark, monkeypatch):
    """All pairs of the two tables of a block meet, but no product's rows are more than both tables'."""
    rows = [(f"b{i % 2}{i:03d}".encode(), b"c%d" % (i % 2), b"") for i in range(60)]
    all_ = spark.createDataFrame(rows, "cls binary, comp binary, grams binary").cache()
    moved, met = [], set()

    def record(members, rule):
        got = members.select("block", "comp", "cls").collect()
        moved.append(len(got))
        groups = {}
        for r in got:
            groups.setdefault((r.block, bytes(r.comp)), set()).add(bytes(r.cls))
        met.update((a, b) for g in groups.values() for a in g for b in g)
        return spark.createDataFrame([], "a binary, b binary")

    monkeypatch.setattr(ngram_join, "_products", record)
    some = all_.where(F.substring(F.col("cls"), -1, 1) == b"3")
    for left, same in ((all_, True), (some, False)):
        moved.clear(), met.clear()
        ngram_join._against(left, all_, ngram_join.Rule(), 10, same=same)
        names = [(bytes(r.cls), bytes(r.comp)) for r in left.collect()]
        assert {(a, bytes(b)) for a, c in names for b, d, _ in rows if c == d} <= met
        assert len(moved) > 2 and max(moved) <= left.count() + 60


def test_context_moves_its_rows_for_the_ranks_before_its_windows(spark, panel):
    """Ranks are stored and the panel they were made of is gone; no wide row is moved by date."""
    before = tables(spark)
    sectors = spark.createDataFrame([(f"T{i}", f"S{i % 2}") for i in range(6)], "ticker string, sector string")
    context = cs.assemble_context(panel_features(panel), sectors)
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    left = [set(spark.read.parquet(f"{folder}/{t}").columns) for t in tables(spark) - before]
    assert not [c for c in left if set(cs.PANEL_COLUMNS) <= c and not set(cs.RANK_FEATURES) <= c]
    assert "FlatMapGroupsInArrow" not in context._jdf.queryExecution().executedPlan().toString()


def test_context_of_a_ticker_of_two_sectors(spark, panel):
    """It has a row for each sector, once, and the ranks of a date count both."""
    listed = [("T0", "S1"), ("T0", "S2"), *[(f"T{i}", "S1") for i in range(1, 6)]]
    feats = panel_features(panel)
    context = cs.assemble_context(feats, spark.createDataFrame(listed, "ticker string, sector string"))
    assert context.count() == feats.count() + feats.where("ticker = 'T0'").count()
    ranks = context.where("date = DATE'2018-02-01'").agg(F.count("rank_log_return_1").alias("n"), F.sum("rank_log_return_1").alias("s"))
    n, s = ranks.first()
    assert n == 6 and abs(s - 3.5) < 1e-9  # T5 is listed later


def test_store_leaves_no_bars(spark):
    before = tables(spark)
    loaded = jobs._store(spark, SMALL)
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    left = [spark.read.parquet(f"{folder}/{t}").columns for t in tables(spark) - before]
    assert not [c for c in left if "close" in c]
    assert loaded["stock_features"].count() == loaded["cross_sectional_features"].count() > 0
