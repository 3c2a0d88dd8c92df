"""News windows, event pressure, aliases and headerless event rows."""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import count_where
from ..plans.skew import frozen

# Windows in calendar days, and the window that defines "recent news".
NEWS_WINDOWS = (1, 3, 7, 14, 30)
EVENT_WINDOWS = (1, 3, 7, 14)
PRESENT_WINDOW = 3
# Alias classes, and those that may match on their own.
EXACT, HISTORICAL, AMBIGUOUS, REJECTED = "EXACT_SAFE", "HISTORICAL_SAFE", "AMBIGUOUS", "REJECTED"
SAFE_CLASSES = (EXACT, HISTORICAL)
# Endings of legal names, and events after which an old name belongs to someone else.
LEGAL_SUFFIXES = ("limited", "ltd.", "ltd", "corporation", "corp.")
MERGED_AWAY = ("merger_into_other_company", "acquired_and_merged")
URL = "^https?://"
#: Cells of the bitmap of alias phrases (2 MB), and parts that a sweep hands on at a time.
PHRASE_CELLS, SWEPT = 1 << 24, 10_000
#: Distinct values of a position that are told apart: 4 make a class, over 20 a tone.
DISTINCT_CAP = 21
ONE_DAY = dt.timedelta(days=1)


class NewsDateError(ValueError):
    """A news row has no publication date, or one that its origin could not have known."""


def assert_dated(news: DataFrame, date: str = "publish_date") -> DataFrame:
    """Raise when a row has no publication date; an index date never stands in for it."""
    if not news.where(F.col(date).isNull()).isEmpty():
        raise NewsDateError("publish_date is required")
    return news


def in_window(publish: Column, origin: Column, days: int) -> Column:
    """Published in ``[origin - days, origin)``; never on the origin day."""
    return (publish < origin) & (publish >= F.date_sub(origin, days))


def window_counts(origins: DataFrame, news: DataFrame, windows: tuple[int, ...] = NEWS_WINDOWS, name: str = "news",
                  first_available: str | None = None) -> DataFrame:
    """Items per origin and window, plus a presence flag.

    News is counted per (ticker, day) first, then origins and days share one
    ordered stream with a frame in days, so nothing is multiplied and a heavy
    ticker is bounded by the calendar.  Before ``first_available`` counts are NULL.
    """
    daily = news.groupBy("ticker", F.col("publish_date").alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    asked = origins.select("ticker", F.col("origin_date").alias("_at")).distinct().withColumn("_asked", F.lit(True))
    stream = asked.join(daily, ["ticker", "_at"], "full").withColumn("_day", F.unix_date("_at"))
    counts = {}
    for n in windows:
        frame = Window.partitionBy("ticker").orderBy("_day").rangeBetween(-n, -1)
        counts[f"{name}_{n}d"] = F.coalesce(F.sum("_c").over(frame), F.lit(0))
    df = stream.withColumns(counts).where("_asked").select("ticker", F.col("_at").alias("origin_date"), *counts)
    if first_available is not None:
        known = F.col("origin_date") > F.lit(first_available).cast("date")
        df = df.withColumns({c: F.when(known, F.col(c)) for c in counts})
    if PRESENT_WINDOW in windows:
        df = df.withColumn(f"{name}_present", F.col(f"{name}_{PRESENT_WINDOW}d") > 0)
    return df


def leading_date(text: Column) -> Column:
    """First date of ``a; b`` in the forms YYYY, YYYY-MM, YYYYMMDD or ISO; anything else is NULL."""
    t = F.trim(F.element_at(F.split(F.trim(text), ";"), 1))
    iso = (F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
           .when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
           .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))))
    return iso.try_cast("date")


def alias_windows(aliases: DataFrame, start: str, end: str) -> DataFrame:
    """Split ``[start, end]`` per ticker at every alias boundary and pick the alias of each part.

    ``aliases``: ticker, alias, class, valid_from, valid_to.  Only safe classes
    count; a dated alias is preferred to an undated one, then by text.  Parts
    without a valid alias are left out.
    """
    return sliced_alias_windows(aliases.select("*", F.lit(start).cast("date").alias("_lo"),
                                               F.lit(end).cast("date").alias("_hi"))).drop("_lo", "_hi")


def sliced_alias_windows(aliases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`alias_windows`, within the span ``_lo``..``_hi`` carried by the rows, for each extra key.

    A sweep over the boundaries of each key in order of date.  What is valid is
    kept in a heap, best first, from which ended aliases are dropped when they
    come to its top, so every alias enters and leaves once.  Of aliases with the
    same span in the same part only the best enters; a key's events are therefore
    bounded by pairs of calendar days, however many aliases it has.
    """
    keys = ["ticker", *by]
    lo, hi, since, until = F.col("_lo"), F.col("_hi"), F.col("valid_from"), F.col("valid_to")
    begin = F.greatest(lo, F.coalesce(since, lo))
    rows = aliases.where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
    usable = (rows.where(F.col("class").isin(*SAFE_CLASSES) & F.col("alias").isNotNull() & (begin <= hi)
                           & (until.isNull() | (until >= begin)))
              .groupBy(*keys, "_lo", "_hi", begin.alias("_at"), F.least(until, hi).alias("_until"), since.isNull().alias("_open_from"),
                       until.isNull().alias("_open_to"))
              .agg(F.min(F.struct("alias", "class")).alias("_a")))
    edges = rows.select(*keys, "_lo", "_hi", F.explode(F.array_compact(F.array(
        lo, F.when((since > lo) & (since <= hi), since),
        F.when((F.date_add(until, 1) > lo) & (F.date_add(until, 1) <= hi), F.date_add(until, 1))))).alias("_at")).distinct()
    none = {"_until": F.lit(None).cast("date"), "_open_from": F.lit(None).cast("boolean"), "_open_to": F.lit(None).cast("boolean"),
            "_a": F.lit(None).cast(usable.schema["_a"].dataType)}
    events = usable.unionByName(edges.withColumns(none)).repartition(*keys).sortWithinPartitions(*keys, "_lo", "_hi", "_at")
    names, many = events.columns, len(keys) + 2
    kinds = events.schema

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, owner, at, edge, held, out = [], None, None, False, None, []

        def settle() -> None:
            """All events of a date are in: close the part before it and open the next."""
            nonlocal held
            if edge:
                close(at - ONE_DAY)
                while heap and heap[0][4] is not None and heap[0][4] < at:
                    heapq.heappop(heap)
                held = (at, *heap[0][2:4]) if heap else None

        def close(end: dt.date) -> None:
            if held is not None:
                out.append((*owner, held[0], end, *held[1:]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[:many]
                if key != owner or row[many] != at:
                    if owner is not None:
                        settle()
                    if key != owner:
                        if owner is not None:
                            close(owner[-1])
                        heap, owner, held = [], key, None
                    at, edge = row[many], False
                _, until_, open_from, open_to, best = row[many:]
                if best is None:
                    edge = True
                else:
                    heapq.heappush(heap, (open_from, open_to, best["alias"], best["class"], until_))
            if len(out) > SWEPT:
                yield swept(out)
                out.clear()
        if owner is not None:
            settle()
            close(owner[-1])
        if out:
            yield swept(out)

    fields = [*[kinds[k] for k in names[:many]], T.StructField("start", T.DateType()), T.StructField("end", T.DateType()),
              T.StructField("alias", T.StringType()), T.StructField("class", T.StringType())]

    def swept(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(fields)}, schema=arrow)

    arrow = aliases.sparkSession.createDataFrame([], T.StructType(fields)).toArrow().schema
    return events.mapInArrow(sweep, T.StructType(fields)).select(*keys, "start", "end", "_lo", "_hi", "alias", "class")


def query_plan(aliases: DataFrame, years: tuple[int, ...], earliest: str, latest: str) -> DataFrame:
    """Alias windows cut by year, with the phrase query of each; two calls per window are budgeted."""
    lo, hi = F.lit(earliest).cast("date"), F.lit(latest).cast("date")
    spans = F.array(*[F.struct(F.lit(y).alias("year"), F.greatest(F.lit(f"{y}-01-01").cast("date"), lo).alias("_lo"),
                               F.least(F.lit(f"{y}-12-31").cast("date"), hi).alias("_hi")) for y in years])
    sliced = aliases.select("*", F.inline(spans)).where(F.col("_lo") <= F.col("_hi"))
    out = sliced_alias_windows(sliced, ("year",))
    return out.select("ticker", "year", "start", "end", "alias", "class",
                      F.concat(F.lit('"'), F.col("alias"), F.lit('"')).alias("query"))


def call_budget(plan: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return plan.groupBy("year").agg(n.alias("n_windows"), (n * 2).alias("coverage_calls"),
                                    F.round(n * 2 / 10.0, 1).alias("estimated_minutes"))


def common_form(name: Column) -> Column:
    """Name without its legal ending, if two or more words are left; else NULL."""
    text = F.trim(name)
    bare = F.lit(None).cast("string")
    found = F.when(F.lit(False), bare)
    for s in LEGAL_SUFFIXES:
        cut = F.trim(F.substring(text, F.lit(1), F.length(text) - (len(s) + 1)))
        ends = F.lower(text).endswith(f" {s}")
        found = found.when(ends & cut.contains(" "), cut)
    return found


def alias_registry(universe: DataFrame, overrides: DataFrame, lineage: DataFrame, official: DataFrame) -> DataFrame:
    """Aliases of every ticker: override, else dated lineage, else official name, else unresolved.

    overrides: (ticker, alias, class, valid_from, valid_to); lineage: (ticker,
    current_name, historical_name, event_type, event_date); official: (ticker,
    company_name).  A name that went to another company is REJECTED.
    """
    over = overrides.select("ticker", "alias", "class", "valid_from", "valid_to").withColumn("_tier", F.lit(1))
    when, current, old = leading_date(F.col("event_date")), F.trim("current_name"), F.trim("historical_name")
    gone = F.col("event_type").isin(*MERGED_AWAY)
    differs = old.isNotNull() & (F.lower(old) != F.lower(current))

    def cell(alias: Column, cls: Column, to: Column, cond: Column) -> Column:
        return F.when(cond & alias.isNotNull(), F.struct(alias.alias("alias"), cls.alias("class"),
                                                         F.lit(None).cast("date").alias("valid_from"), to.alias("valid_to")))

    none = F.lit(None).cast("date")
    yes = F.lit(True)
    lin = lineage.select("ticker", F.lit(2).alias("_tier"), F.inline(F.array_compact(F.array(
        cell(current, F.lit(EXACT), none, yes), cell(common_form(current), F.lit(EXACT), none, yes),
        cell(old, F.when(gone, REJECTED).otherwise(HISTORICAL), when, differs),
        cell(common_form(old), F.lit(HISTORICAL), when, differs & ~F.coalesce(gone, F.lit(False)))))))
    raw = F.trim("company_name")
    name = F.when(raw == F.upper(raw), F.initcap(F.lower(raw))).otherwise(raw)
    off = official.where((raw != "") & (F.upper(raw) != "UNKNOWN")).select("ticker", F.lit(3).alias("_tier"), F.inline(
        F.array_compact(F.array(cell(name, F.lit(EXACT), none, yes), cell(common_form(name), F.lit(EXACT), none, yes)))))
    every = over.unionByName(lin).unionByName(off)
    best = every.groupBy("ticker").agg(F.min("_tier").alias("_best"))
    kept = every.join(best, "ticker").where(F.col("_tier") == F.col("_best")).drop("_best")
    status = (F.when(F.col("_tier") == 1, "RESOLVED_FROM_OVERRIDE").when(F.col("_tier") == 2, "RESOLVED_FROM_LINEAGE")
              .when(F.col("_tier") == 3, "RESOLVED_FROM_OFFICIAL_NAME").otherwise("UNRESOLVED"))
    return universe.select("ticker").join(kept, "ticker", "left").select(
        "ticker", "alias", "class", "valid_from", "valid_to", status.alias("resolution_status"))


def alias_collisions(registry: DataFrame) -> DataFrame:
    """Safe aliases, case ignored, that more than one ticker claims."""
    safe = registry.where(F.col("class").isin(*SAFE_CLASSES)).select(
        "ticker", F.lower(F.trim("alias")).alias("alias")).distinct()
    return safe.groupBy("alias").agg(F.count(F.lit(1)).alias("n_tickers")).where(F.col("n_tickers") > 1)


def words(text: Column) -> Column:
    """Lower-case word sequence of a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, one for each first word."""
    out = np.full(max(0, len(values) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ values[i:len(values) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _word_hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


@F.arrow_udf(T.LongType())
def _phrase_hash(hashes: pa.Array) -> pa.Array:
    """Hash of a whole phrase, as of a run of words."""
    return pa.array([int(_run_hashes(np.array(h, dtype=np.int64).view(np.uint64), len(h)).view(np.int64)[0])
                     for h in hashes.to_pylist()], pa.int64())


def headline_relevance(articles: DataFrame, aliases: DataFrame, cells: int = PHRASE_CELLS) -> DataFrame:
    """Articles naming a safe alias, marked as named in the title or only in the body.

    Phrases are matched word for word and whole texts are read.  Runs of words
    are looked up by hash in a bitmap of all phrases (2 MB, however many there
    are) while a text is read, so only runs that are very likely a phrase leave
    it; those are joined with the phrases by equality.  A crowded bitmap lets
    more through, never fewer.  ``articles``: article_id, title, body; ``cells``
    is a power of two.
    """
    spark = articles.sparkSession
    phrases = aliases.where(F.col("class").isin(*SAFE_CLASSES)).select("ticker", words(F.col("alias")).alias("_w")).where(
        F.size("_w") > 0).select("ticker", F.array_join("_w", " ").alias("phrase"), "_w").distinct()
    lengths = sorted(r["n"] for r in phrases.select(F.size("_w").alias("n")).distinct().collect())
    if not lengths:
        return articles.limit(0).select("article_id", F.lit("").alias("ticker"), F.lit("").alias("relevance"))
    cell = _phrase_hash(_word_hashes(F.col("_w"))).bitwiseAND(F.lit(cells - 1))
    packed = phrases.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(cells // 64, dtype=np.uint64)
    bitmap[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])))
    def likely(hashes: pa.Array) -> pa.Array:
        """Where in each text a run of words falls into a set cell."""
        found, ends = [], [0]
        starts = hashes.offsets.to_numpy()
        flat = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for a, b in zip(starts, starts[1:]):
            for n in lengths:
                cell = _run_hashes(flat[a:b], n) & np.uint64(cells - 1)
                hit = held.value[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1) == 1
                found += [(int(i) + 1, n) for i in np.flatnonzero(hit)]
            ends.append(len(found))
        pairs = pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["at", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    texts = articles.select("article_id", F.inline(F.array(
        F.struct(F.lit(1).alias("_title"), F.col("title").alias("_text")),
        F.struct(F.lit(0).alias("_title"), F.col("body").alias("_text")))))
    read = texts.select("article_id", "_title", F.coalesce(words(F.col("_text")), F.array().cast("array<string>")).alias("_w"))
    runs = read.withColumn("_runs", likely(_word_hashes(F.col("_w"))))
    hits = runs.select("article_id", "_title", F.explode(F.array_distinct(F.transform(
        "_runs", lambda r: F.array_join(F.slice("_w", r["at"], r["n"]), " ")))).alias("phrase"))
    out = hits.join(phrases.drop("_w"), "phrase").groupBy("article_id", "ticker").agg(F.max("_title").alias("_t"))
    return out.select("article_id", "ticker", F.when(F.col("_t") == 1, "TITLE_EXPLICIT").otherwise("BODY_MATCH_ONLY").alias(
        "relevance"))


def capped_distinct(rows: DataFrame, cap: int = DISTINCT_CAP, fields: str = "fields") -> DataFrame:
    """(pos, n_distinct): distinct present values at each position of the lists, counted no further than ``cap``.

    A task keeps a set for each position and looks at it no more once the set is
    full; only the sets meet, at most ``cap`` values a position and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for batch in batches:
            lists = batch.column(0)
            lists = lists.filter(lists.is_valid())
            ends = lists.offsets.to_numpy()
            values = lists.values.slice(ends[0], ends[-1] - ends[0])
            place = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            for at in np.split(order, starts[1:]) if len(order) else []:
                held = seen.setdefault(int(place[at[0]]), set())
                if len(held) < cap:
                    for v in values.take(pa.array(at)).unique().to_pylist():
                        if v is not None and len(held) < cap:
                            held.add(v)
        pairs = [(p, v) for p, held in seen.items() for v in (held or {None})]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.string())],
                                         names=["pos", "v"])

    sets = rows.select(F.col(fields).cast("array<string>").alias("f")).mapInArrow(run, "pos int, v string")
    return sets.groupBy("pos").agg(F.least(F.count_distinct("v"), F.lit(cap).cast("bigint")).alias("n_distinct"))


def infer_columns(rows: DataFrame, stamp: Column, country: str = "India", code: str = "IN") -> DataFrame:
    """Meaning of the positions of headerless rows, found by invariants.

    One pass per position: the stamp (always equal to ``stamp``), the URL, the
    four-valued class, the scale whose class means order 2 > 1 > 3 > 4, the
    tone (first other number with over 20 distinct values, some fractional),
    country names, and country codes beside a name.  One row per (role, position).
    Stamp and URL are reported only if exactly one position qualifies.
    """
    width = F.size("fields")
    cells = rows.select(F.posexplode("fields").alias("pos", "v"), stamp.alias("_stamp"), width.alias("_w"))
    num = F.col("v").try_cast("double")
    flags = cells.groupBy("pos").agg(
        F.bool_and(F.coalesce((F.col("v") == F.col("_stamp")) & F.col("v").rlike(r"^\d{14}$"), F.lit(False))).alias("is_stamp"),
        F.bool_and(F.coalesce(F.col("v").rlike(URL), F.lit(False))).alias("is_url"),
        F.bool_and(F.coalesce(F.col("v").isin("1", "2", "3", "4"), F.lit(False))).alias("four"),
        F.coalesce(F.bool_and(F.when(num.isNotNull(), F.abs(num) <= 1e6)), F.lit(False)).alias("is_number"),
        F.bool_and(num.isNotNull()).alias("all_numbers"),
        F.bool_or(F.col("v").contains(".")).alias("fractional"),
        F.bool_or(F.lower(F.trim("v")) == country.lower()).alias("is_country"))
    # A row a position; stored, as several of the steps below ask it.
    per = frozen(flags.join(capped_distinct(rows), "pos").withColumn("is_class", F.col("four") & (F.col("n_distinct") == 4)).drop("four"))
    roles = per.select("*", F.explode(F.array_compact(F.array(
        F.when(F.col("is_stamp"), "date_added"), F.when(F.col("is_url"), "source_url"), F.when(F.col("is_class"), "quad_class"),
        F.when(F.col("is_country"), "country_name")))).alias("role")).select("role", "pos")
    alike = F.count(F.lit(1)).over(Window.partitionBy("role"))  # at most one row per position of a line
    roles = roles.withColumn("_alike", alike).where(
        ~F.col("role").isin("date_added", "source_url") | (F.col("_alike") == 1)).drop("_alike")
    # The class position is a single small value; rows are then keyed by their own class.
    quad = [r["pos"] for r in roles.where(F.col("role") == "quad_class").orderBy("pos").collect()]
    names = [r["pos"] for r in roles.where(F.col("role") == "country_name").collect()]
    found = roles
    if quad:
        q = F.get("fields", F.lit(quad[0]))
        means = rows.select(q.alias("q"), F.posexplode("fields").alias("pos", "v")).groupBy("pos").agg(
            *[F.avg(F.when(F.col("q") == c, F.col("v").try_cast("double"))).alias(f"m{c}") for c in "1234"])
        ordered = (F.col("m2") > F.col("m1")) & (F.col("m1") > F.col("m3")) & (F.col("m3") > F.col("m4"))
        numbers = per.where(F.col("is_number") & ~F.col("is_class"))
        scale = [r["pos"] for r in numbers.where("all_numbers").join(means, "pos").where(ordered).select("pos").orderBy(
            "pos").collect()][:1]
        if scale:
            tone = numbers.where((F.col("pos") != scale[0]) & (F.col("n_distinct") > 20) & F.col("fractional")).agg(
                F.min("pos").alias("pos")).where(F.col("pos").isNotNull())
            spark = rows.sparkSession
            found = found.unionByName(spark.createDataFrame([("goldstein", scale[0])], roles.schema)).unionByName(
                tone.select(F.lit("avg_tone").alias("role"), "pos"))
    if names:
        near = F.lit(False)
        for p in names:
            near = near | ((F.abs(F.col("pos") - p) <= 2) & (F.lower(F.trim(F.get("fields", F.lit(p)))) == country.lower()))
        codes = rows.select("fields", F.posexplode("fields").alias("pos", "v")).where(
            (F.upper(F.trim("v")) == code) & near).select(F.lit("country_code").alias("role"), "pos").distinct()
        found = found.unionByName(codes)
    return found


def country_events(rows: DataFrame, name_positions: list[int], code_positions: list[int], quad: int, scale: int,
                   country: str = "India", code: str = "IN", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows about a country, by name in any name field or code in any code field: counts and mean scale per class."""
    named = F.exists(F.array(*[F.get("fields", F.lit(p)) for p in name_positions]),
                     lambda x: F.lower(F.trim(x)) == country.lower()) if name_positions else F.lit(False)
    coded = F.exists(F.array(*[F.get("fields", F.lit(p)) for p in code_positions]),
                     lambda x: F.upper(F.trim(x)) == code) if code_positions else F.lit(False)
    hit = F.coalesce(named, F.lit(False)) | F.coalesce(coded, F.lit(False))
    kept = rows.where(hit)
    return kept.groupBy(*by, F.get("fields", F.lit(quad)).alias("quad_class")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(F.get("fields", F.lit(scale)).try_cast("double")).alias("mean_scale"))


def hit_coverage(daily: DataFrame) -> DataFrame:
    """Totals, days with a match and the median of such days, per year.

    ``daily``: ticker, day, n, title_n, measured.  What was not measured stays NULL, never 0.
    """
    per_ticker = daily.where("measured").groupBy("ticker", F.year("day").alias("year")).agg(
        F.sum("n").alias("total"), F.sum("title_n").alias("title_total"), count_where(F.col("n") > 0).alias("match_days"))
    measured = per_ticker.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_tickers"), F.sum("total").alias("total"), F.sum("title_total").alias("title_total"),
        F.percentile("match_days", F.lit(0.5)).alias("median_match_days"))
    years = daily.select(F.year("day").alias("year")).distinct()
    return years.join(measured, "year", "left").withColumn("n_tickers", F.coalesce("n_tickers", F.lit(0)))
