"""Alias windows against plain enumeration of days, phrases against plain search."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import news

DAY = dt.date(2015, 1, 1)
SCHEMA = "ticker string, alias string, class string, valid_from date, valid_to date"


def day(i):
    return None if i is None else DAY + dt.timedelta(days=i)


def by_days(rows, lo, hi):
    """(ticker, start, end, alias, class) from the best alias of every single day."""
    out = []
    for ticker in sorted({r[0] for r in rows if r[0]}):
        own = [r for r in rows if r[0] == ticker]
        edges = {lo} | {r[3] for r in own if r[3] is not None and lo < r[3] <= hi} | {
            r[4] + 1 for r in own if r[4] is not None and lo < r[4] + 1 <= hi}
        starts = sorted(edges)
        for a, b in zip(starts, [*starts[1:], hi + 1]):
            valid = [r for r in own if r[2] in news.SAFE_CLASSES and r[1] and (r[3] is None or r[3] <= a) and (r[4] is None or a <= r[4])]
            if valid:
                best = min(valid, key=lambda r: (r[3] is None, r[4] is None, r[1], r[2]))
                out.append((ticker, day(a), day(b - 1), best[1], best[2]))
    return sorted(out)


def aliases(seed=1, tickers=6, each=60):
    rng = random.Random(seed)
    rows = []
    for t in range(tickers):
        for _ in range(each):
            since, until = rng.choice([None, rng.randrange(-30, 140)]), rng.choice([None, rng.randrange(-30, 140)])
            rows.append((f"T{t}", rng.choice("abcdefgh") * rng.randrange(1, 4), rng.choice([news.EXACT, news.HISTORICAL, news.REJECTED]), since, until))
    return [*rows, (None, "x", news.EXACT, 1, 2), ("T0", None, news.EXACT, 5, 50), ("U", "gone", news.REJECTED, 3, 4), ("V", "late", news.EXACT, 500, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep(spark, monkeypatch, seed):
    monkeypatch.setattr(news, "SWEPT", 7)
    rows = aliases(seed)
    df = spark.createDataFrame([(t, a, c, day(f), day(u)) for t, a, c, f, u in rows], SCHEMA).repartition(3)
    got = news.alias_windows(df, "2015-01-01", "2015-04-11")
    assert sorted(tuple(r) for r in got.select("ticker", "start", "end", "alias", "class").collect()) == by_days(rows, 0, 100)
    assert news.alias_windows(df.limit(0), "2015-01-01", "2015-04-11").count() == 0


def test_one_ticker_with_very_many_aliases(spark):
    df = spark.range(100_000).select(F.lit("T").alias("ticker"), F.concat(F.lit("n"), "id").alias("alias"), F.lit(news.EXACT).alias("class"),
                                     F.date_add(F.lit(DAY), (F.col("id") % 97).cast("int")).alias("valid_from"),
                                     F.date_add(F.lit(DAY), (F.col("id") % 97 + F.col("id") % 31).cast("int")).alias("valid_to"))
    got = news.alias_windows(df, "2015-01-01", "2015-04-11").orderBy("start").collect()
    assert len(got) == 101 and got[0]["alias"] == "n0" and [r["start"] for r in got] == [day(i) for i in range(101)]


def test_phrases(spark):
    rng = random.Random(4)
    words = ["tata", "steel", "Ähre", "日本", "x1", "co", "the", "of"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    table = [(str(i % 25), n.title() + rng.choice(["", ".", " &"]), rng.choice([news.EXACT, news.AMBIGUOUS])) for i, n in enumerate(names)] + [("e", "...", news.EXACT)]
    texts = [(i, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(4))]),
              rng.choice([None, ", ".join(rng.choice(words).upper() for _ in range(rng.randrange(0, 30)))])) for i in range(120)]
    split = lambda t: " " + " ".join(w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w) + " "
    want = set()
    for i, title, body in texts:
        for ticker, alias, kind in table:
            if kind == news.EXACT and split(alias).strip():
                if split(alias) in split(title):
                    want.add((i, ticker, "TITLE_EXPLICIT"))
    explicit = {w[:2] for w in want}
    for i, _, body in texts:
        for ticker, alias, kind in table:
            if kind == news.EXACT and split(alias).strip() and split(alias) in split(body) and (i, ticker) not in explicit:
                want.add((i, ticker, "BODY_MATCH_ONLY"))
    articles = spark.createDataFrame(texts, "article_id long, title string, body string")
    al = spark.createDataFrame(table, "ticker string, alias string, class string")
    for cells in (news.PHRASE_CELLS, 64):  # the small bitmap lets nearly everything through
        assert {tuple(r) for r in news.headline_relevance(articles, al, cells).collect()} == want
    assert news.headline_relevance(articles, al.limit(0)).count() == 0


def test_distinct_values_are_counted_to_the_cap(spark):
    rows = [([str(i % 4), str(i), None, "x" if i % 2 else None] + (["late"] if i > 90 else []),) for i in range(200)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "fields array<string>").repartition(5)
    assert {r["pos"]: r["n_distinct"] for r in news.capped_distinct(df).collect()} == {0: 4, 1: news.DISTINCT_CAP, 2: 0, 3: 1, 4: 1}
    assert news.capped_distinct(df.limit(0)).count() == 0
