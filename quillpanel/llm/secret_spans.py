"""Secrets in texts: fixed patterns, and strings that look random to a character model.

Two Markov models of characters are trained from labelled samples: one on the
random strings that the fixed patterns find, one on ordinary identifiers, long
tokens that are words, numbers or marks put together (``ORDINARY``).  Tokens that are
neither teach nothing, so a secret that no pattern finds cannot pass for ordinary.
A token that the first model explains better by ``MARGIN`` nats or more is added as
a span of kind ``random``.
All in DataFrame operations: counts of character pairs are grouped by Spark, and
the two models come back as one table of ``len(ALPHABET)`` squared log ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed patterns by kind, in the order of the result (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: The least length of what an assignment assigns.
ASSIGNED = 6
#: Tokens that the models judge, and the characters they are made of.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Words in one case, in capitals or joined camel-wise, numbers, and marks, with marks between them.
ORDINARY = r"^(?:(?:[A-Z]?[a-z]++)++|[A-Z]++|[0-9]++|(?=[+/_=-]))(?:[+/_=-]++(?:(?:[A-Z]?[a-z]++)++|[A-Z]++|[0-9]++)?)*+$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio from which a token is taken for random: odds of a thousand to one against.
MARGIN = math.log(1000.0)
BACKOFF = 20.0
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, valid=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points; ``valid`` judges the given group."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("found"), judged.alias("judged"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["found"])
        good = row["found"].isNotNull()
        good = good & valid(row["judged"]) if valid else good
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.when(row["found"].isNull(), state).otherwise(F.struct(
            end.alias("at"), F.when(good, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out")))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_assign``, ``_access`` and ``_hex``; a text without a pattern's first characters is not searched."""
    whole, none = F.col(f"`{text}`"), F.array().cast(SPAN)
    assign = spans(whole, ASSIGN, 0, lambda value: F.length(value) >= ASSIGNED, 2)
    return (docs.withColumn("_assign", F.when(whole.rlike(ASSIGN), assign).otherwise(none))
            .withColumn("_access", F.when(whole.contains("AKIA"), spans(whole, ACCESS, 1)).otherwise(none))
            .withColumn("_hex", F.when(whole.rlike(HEX), spans(whole, HEX, 2)).otherwise(none)))


def _pairs(token: Column) -> Column:
    """Numbers of a token's neighbouring characters: row times alphabet size plus column."""
    place = (lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1))) - 1)
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: place(i) * len(ALPHABET) + place(i + 1))


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """(random, pair, n): pairs of characters in labelled tokens; ``docs`` has base spans.

    Labelled random: tokens inside what the patterns find.  Ordinary: tokens of
    the shape ``ORDINARY`` in texts in which the patterns find nothing, one for each
    text and distinct token.
    """
    whole = F.col(f"`{text}`")
    base = F.concat("_assign", "_access", "_hex")
    token = F.lit(TOKEN)
    secret = F.flatten(F.transform(base, lambda s: F.regexp_extract_all(
        whole.substr(s["start"] + 1, s["end"] - s["start"]), token, F.lit(0))))
    plain = F.filter(F.regexp_extract_all(whole, token, F.lit(0)), lambda t: t.rlike(ORDINARY))
    chosen = F.when(F.size(base) > 0, secret).otherwise(F.array_distinct(plain))
    tokens = docs.select((F.size(base) > 0).alias("random"), F.explode(chosen).alias("token"))
    tokens = tokens.groupBy("random", "token").agg(F.count(F.lit(1)).alias("times"))
    return tokens.select("random", "times", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy(
        "random", "pair").agg(F.sum("times").alias("n"))


def log_ratios(counts: list[tuple[bool, int, int]]) -> list[float]:
    """Log of (probability of the second character after the first) under random over under ordinary.

    Each row of a model is drawn towards its frequencies of characters (add-one)
    with the weight of ``BACKOFF`` pairs, so that characters which ordinary tokens
    hardly have are improbable after any other.
    """
    size = len(ALPHABET)
    tables = {label: [0.0] * size * size for label in (True, False)}
    for label, pair, n in counts:
        if 0 <= pair < size * size:
            tables[label][pair] += n

    def log_probabilities(table: list[float]) -> list[float]:
        total = sum(table)
        share = [(sum(table[c::size]) + 1) / (total + size) for c in range(size)]
        rows = [table[r * size:(r + 1) * size] for r in range(size)]
        return [math.log((n + BACKOFF * p) / (sum(row) + BACKOFF)) for row in rows for n, p in zip(row, share)]

    return [a - b for a, b in zip(log_probabilities(tables[True]), log_probabilities(tables[False]))]


def _ratio(token: Column, ratios: Column) -> Column:
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, pair: total + F.element_at(ratios, pair + 1))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """id and spans (start, kind, end in code points; kind as in ``KINDS``) by start and kind, of every document.

    Matches of the patterns are all there, whatever the models say; a random
    token is added where it overlaps none of them.  NULL texts are empty and have
    no spans, an empty table gives no rows; with no labelled secret the models are
    not made and nothing is added.  Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text"))
    marked = with_base_spans(rows, "_text")
    # At most twice len(ALPHABET) squared rows.
    counts = [(r["random"], r["pair"], r["n"]) for r in pair_counts(marked, "_text").collect()]
    learnt = any(label for label, _, _ in counts)
    base = F.concat("_assign", "_access", "_hex")
    if learnt:
        ratios = F.split(F.lit(",".join(f"{x:.12g}" for x in log_ratios(counts))), ",").cast("array<double>")
        random = (lambda token: _ratio(token, ratios) >= margin)
        whole = F.col("_text")
        tokens = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))
        found = F.when(F.exists(tokens, random), spans(whole, TOKEN, 3, random)).otherwise(F.array().cast(SPAN))
        marked = marked.withColumn("_random", found)
        free = F.filter("_random", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        every = F.concat(base, free)
    else:
        every = base
    return marked.select(F.col("_id").alias(id_col), F.sort_array(every).alias("spans"))


def shown(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
