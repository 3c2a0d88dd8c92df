"""Exact copies, linked documents and repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillpanel.llm import exact_dedup, ngram_join, suffix_dedup
from quillpanel.llm.components import components

from .conftest import odd_texts, prose


def lower_az(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def key(value):
    return (value is not None, value)


# ---- exact copies ----------------------------------------------------------


@pytest.mark.parametrize("cells", [exact_dedup.MOST_CELLS, 1 << 16])
def test_exact_groups(odd, cells):
    groups = {}
    for i, text in odd_texts():
        groups.setdefault(lower_az(text or ""), []).append(i)
    rows = exact_dedup.exact_duplicates(odd, most_cells=cells).collect()
    want = Counter()
    for text, ids in groups.items():
        keep, stays = max(ids, key=lambda i: -1 if i is None else i), False
        for i in ids:
            first = i == keep and not stays
            stays |= first
            want[(i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, rows)) == want


def test_saturated_filter_changes_nothing(spark):
    """All cells taken: every row is shuffled, and the result is the same."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 1000).cast("string").alias("text"))
    a = exact_dedup.exact_duplicates(docs, most_cells=1 << 6)
    assert {tuple(r) for r in a.select("keep_id", "group_size").distinct().collect()} == {
        (2000 + i, 3) for i in range(1000)}


def test_documents_that_stay(odd, empty):
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    got = left.select("doc_id", "text").collect()
    assert len(got) == len({lower_az(t or "") for _, t in odd_texts()})
    assert len([r for r in got if r.doc_id == 7]) == 1 and not [r for r in got if r.doc_id in (1, 4)]
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# ---- linked documents ------------------------------------------------------


def gram_set(text: str | None, words: int) -> frozenset:
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", lower_az(text or "")) if w]
    many = min(words, len(found))
    return frozenset(tuple(found[i:i + many]) for i in range(len(found) - many + 1)) if many else frozenset()


def brute_components(rows, words: int, num: int) -> Counter:
    sets = [gram_set(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= num * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in set(group)}
    return Counter((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group))


def many_near_copies():
    import random

    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    return [*rows, *[(100 + i, prose(rng, 80)) for i in range(20)]]


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_components_of_odd_texts(odd, words, num):
    rows = ngram_join.linked_documents(odd, ngram_join.Rule(words, num, 100)).collect()
    assert Counter(map(tuple, rows)) == brute_components(odd_texts(), words, num)


@pytest.mark.parametrize("options", [{}, {"block_docs": 16}])
def test_components_of_near_copies(spark, options):
    """The second case cuts the block, so that members meet in the products of sub-blocks."""
    data = many_near_copies()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = ngram_join.linked_documents(docs, ngram_join.Rule(3, 90, 100), **options).collect()
    assert Counter(map(tuple, rows)) == brute_components(data, 3, 90)


def test_no_links_in_an_empty_table(empty):
    assert ngram_join.linked_documents(empty, ngram_join.Rule()).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_parts_cover_every_linked_pair(num):
    """Sets at the threshold share a part's content whatever differs."""
    import numpy as np

    rng = np.random.default_rng(3)
    rule = ngram_join.Rule(3, num, 100)
    ends = rule.size_classes(1 << 40)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64))[:size]
        drop = int(rng.integers(0, size * (100 - num) // 90 + 1))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if common and 100 * common >= num * (len(base) + len(other) - common):
            for share in (0.0, 0.2, 0.9, 1.0):  # of n-grams that count as common
                a, b = (ngram_join.signatures(s, s % np.uint64(1000) < np.uint64(1000 * share), rule, ends, {}) for s in (base, other))
                assert len(np.intersect1d(a, b))


def test_component_labels(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.label for r in got} == {n: label[n] for n in linked}


# ---- repeated strings ------------------------------------------------------


def brute_cut(rows, length: int) -> Counter:
    seen, out = Counter(), Counter()
    bodies = [(t or "").encode() for _, t in rows]
    for body in bodies:
        seen.update(body[i:i + length] for i in range(len(body) - length + 1))
    for (i, _), body in zip(rows, bodies):
        gone = bytearray(len(body))
        for a in range(len(body) - length + 1):
            if seen[body[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(i, len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("options", [{"length": 400}, {"length": 60, "gram": 16}, {"length": 60, "gram": 16, "most_cells": 64}])
def test_repeated_strings(odd, options):
    """The last case has a bitmap far too small for the data."""
    rows = suffix_dedup.cut_repeats(odd, **options).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    assert got == brute_cut(odd_texts(), options["length"])


def test_long_texts_in_segments(odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    texts = [(t or "").encode() for _, t in odd_texts()]
    whole = {}
    for data, runs, origin in suffix_dedup.runs_of(texts, 100, 16):
        for (p, a, b), (number, shift) in zip(runs.tolist(), origin.tolist()):
            for start in range(a, b + 1):
                whole[(number, start + shift)] = p + shift
    for number, text in enumerate(texts):
        if len(text) >= 100:
            plain = suffix_dedup.window_anchors(text, 100, 16)
            assert [whole[(number, i)] for i in range(len(plain))] == plain.tolist()


def test_empty_table_has_no_repeats(empty):
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_spans_of_many_rows_at_once():
    """Runs in any order, repeated, touching, nested; rows without runs; a slice of a batch; spans up to a text's end."""
    rng = random.Random(8)
    rows = [[], [(0, 0)], [(5, 6), (0, 2), (0, 2)], [], [(10, 10), (0, 9)], [(0, 0), (11, 11)]]
    rows += [[(a, a + rng.randrange(4)) for a in rng.choices(range(80), k=rng.randrange(12))] for _ in range(200)]
    runs = pa.array([[{"lo": a, "hi": b} for a, b in r] for r in rows],
                    pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    for first in (0, 3):
        size = np.array([max([0, *[b + 10 for _, b in r]]) for r in rows[first:]])
        got = list(zip(*(v.tolist() for v in suffix_dedup.merged_spans(runs.slice(first), size, 10))))
        want = []
        for i, r in enumerate(rows[first:]):
            covered = bytearray(size[i])
            for a, b in r:
                covered[a:b + 10] = b"\1" * (b + 10 - a)
            want += [(i, m.start(), m.end()) for m in re.finditer(b"\1+", bytes(covered))]
        assert got == want


def test_a_single_window_is_hashed_once(monkeypatch):
    """Both identifiers come from one hash of its bytes."""
    calls = []
    plain = suffix_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_128_digest", lambda b: calls.append(b) or plain(b))
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_64_intdigest", None)
    data = [b"abcdefghijabcdefghij", b"xyabcdefghijz"]
    runs, core, hull = suffix_dedup.cut_runs(data, [(0, 4, 0, 10), (1, 5, 2, 3)], 1, 8, 4)
    assert runs.tolist() == [[0, 4, i, i] for i in range(11)] + [[1, 5, i, i] for i in (2, 3)]
    assert calls == [data[i][a:a + 8] for i, _, a, _ in runs.tolist()]
    assert core[0] == core[10] == core[11] and hull[0] == hull[10] == hull[11] and len(set(core.tolist())) == 10
