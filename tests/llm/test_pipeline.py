"""Pseudonyms, the pipeline against a brute-force version, and registration."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillpanel.llm import pseudonyms as ps

from .conftest import odd_texts
from .test_dedup import brute_components, lower_az

VALUES = ["bosbt.42@mail8.example.com", "A_B@Example.org", "4041894974608795", "4111 1111 1111 1111", "3782 822463 10005",
          "+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "123-45-6789", "42.144.35.254", "0.0.0.0", "2023-02-28",
          "28/02/2023", "02/28/2023", "averylonglocalpart.thatgoeson12345@x.org"]
NO_VALUES = ["1 555 123 4567 89", "31.02.1985", "12.03.1985.1", "100 200 300", "4041894974608796", "000-12-3456", "666-12-3456", "1.2.3.4.5", "256.1.1.1", "2023-02-30", "a.b@c",
             "1" * 25, "2101-01-01", "12-34", "@", "no digits"]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def changed(spark, values, **options):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in ps.pseudonymised(docs, "key", **options).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_come_back(spark):
    sentences = [f"see {v}, and again {v}." for v in VALUES]
    new = changed(spark, sentences)
    for old, text, value in zip(sentences, new, VALUES):
        a, b = re.fullmatch("see (.*), and again (.*)\\.", text).groups()
        assert a == b != value
        if re.fullmatch(r"[0-9.]{7,}", value) and "." in value:
            assert re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", a) and all(int(x) < 256 for x in a.split("."))
        else:
            assert len(a) == len(value)
            assert "@" in value or re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", value)
        if value.startswith(("4", "37")) and "." not in value and "-" not in value:
            assert luhn(a)
    back = changed(spark, new, restore=True)
    lowered = [re.sub(r"\S+@", lambda m: m[0].lower(), s) for s in sentences]
    assert back == [s.replace("02/28/2023", "28/02/2023") for s in lowered]


#: Every form of every shape; the phones after the first three hold no four digits in a row.
ALONE = [*VALUES, "+4712345678", "+47 12 34 56 78", "+45 12-34-56-78", "+49 30 123 456", "+49 (30) 123 456", "+33 6 12 34 56 78",
         "+33.1.23.45.67.89", "+33 (0)6 12 34 56 78", "+46 8 123 456 78", "+353 1 234 567", "+55 11 9 123 45 67",
         "+41 44 668 1 800", "+49 30 12 34 56 78", "+49 30 1234 5678 20", "555 123 4567", "1-555-123-4567", "1 555 123 4567", "12.03.1985"]


def test_every_shape_alone_in_a_text(spark):
    """A value is found, and becomes the same, whether or not its text holds another value."""
    alone = changed(spark, [f"call {v} now" for v in ALONE])
    beside = changed(spark, [f"call {v} now or write to a@b.org" for v in ALONE])
    for value, a, b in zip(ALONE, alone, beside):
        a, b = a[5:-4], b[5:].split(" now")[0]
        assert a == b != value
        if value.startswith("+"):
            assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", value)
    back = [t[5:-4] for t in changed(spark, alone, restore=True)]
    phones = [i for i, v in enumerate(ALONE) if v.startswith("+")]
    assert [back[i] for i in phones] == [ALONE[i] for i in phones]


def test_one_digit_groups_keep_to_the_length_of_a_phone(spark):
    short = ["+1 2 3 4 5", "+3 12 4 20", "a +1 for b"]
    assert changed(spark, short) == short
    (long,) = changed(spark, ["+353 1 234 5678 9012 3456"])  # 19 digits in all
    assert long.startswith("+353 ") and long.endswith(" 3456") and long[5:-5] != "1 234 5678 9012"


def test_equal_values_stay_linked_across_formats(spark):
    a, b, c, d, e = changed(spark, ["+1 (988) 555-2485", "988-555-2485", "28/02/2023", "2023-02-28", "4111111111111111"])
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)
    assert "-".join(reversed(c.split("/"))) == d
    assert changed(spark, ["4111-1111-1111-1111"])[0].replace("-", "") == e


#: Spellings of one number of each country.
SPELLINGS = [["+493012345678", "+49 30 12345678", "+49 30 12 34 56 78", "+49 (30) 12 34 56 78", "+49-30-1234-5678"],
             ["+35312345678", "+353 1 234 5678", "+353.1.234.5678"], ["+33612345678", "+33 6 12 34 56 78"],
             ["+15551234567", "+1 (555) 123-4567", "1-555-123-4567", "1 555 123 4567", "(555) 123-4567", "555 123 4567",
              "555.123.4567", "555-123-4567"]]


def test_spellings_of_one_phone_are_linked_and_no_group_is_left(spark):
    for group in SPELLINGS:
        new = changed(spark, [f"ring {v}, or so" for v in group])
        digits = {re.sub(r"\D", "", t)[-9:] for t in new}
        assert len(digits) == 1 and digits != {re.sub(r"\D", "", group[0])[-9:]}
        assert [re.sub("[0-9]", "0", t) for t in new] == [re.sub("[0-9]", "0", f"ring {v}, or so") for v in group]


def test_a_phone_before_another_number(spark):
    (text,) = changed(spark, ["+49 30 1234 5678 2024 and on"])  # 16 digits in all, 12 of them the phone's
    assert text.endswith(" 2024 and on") and "1234 5678" not in text


def network(left, right, high, low, kind):
    """A Feistel network of eight rounds, written without Spark."""
    for n in range(8):
        other, size = (right, high) if n % 2 == 0 else (left, low)
        noise = int(hashlib.sha256(f"key|{kind}|{n}|{other}|{high}|{low}".encode()).hexdigest()[:15], 16)
        if n % 2 == 0:
            left = (left + noise) % size
        else:
            right = (right + noise) % size
    return left, right


def brute_digits(symbols: str, radix: int, kind: str) -> str:
    half = len(symbols) // 2
    sizes = radix ** half, radix ** (len(symbols) - half)
    pair = network(int(symbols[:half] or "0", radix), int(symbols[half:] or "0", radix), *sizes, kind)
    return "".join(np.base_repr(n, radix).lower().zfill(w) for n, w in zip(pair, (half, len(symbols) - half)) if w)


def filled(value: str, symbols: str) -> str:
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in value)


def brute(value: str) -> str:
    """The pseudonym of a valid value, by its look."""
    digits = re.sub(r"\D", "", value)
    if "@" in value:
        local, domain = value.lower().split("@")[0], value.split("@")[1]
        plain = re.sub("[^a-z0-9]", "", local)
        return filled(local, "".join(brute_digits(plain[i:i + 12], 36, "email") for i in range(0, len(plain), 12))) + "@" + domain
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
        a, b, c, d = map(int, value.split("."))
        left, right = network(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
        areas = [a for a in range(1, 900) if a != 666]
        place, serial = network(areas.index(int(value[:3])) * 99 + int(value[4:6]) - 1, int(value[7:]) - 1, 898 * 99, 9999, "ssn")
        return f"{areas[place // 99]:03d}-{place % 99 + 1:02d}-{serial + 1:04d}"
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            day = (datetime.datetime.strptime(value, form) - datetime.datetime(1900, 1, 1)).days
        except ValueError:
            continue
        left, right = network(day // 270, day % 270, 270, 270, "date")
        new = datetime.datetime(1900, 1, 1) + datetime.timedelta(days=left * 270 + right)
        return new.strftime("%d/%m/%Y" if "/" in value else form)
    if re.match(r"[+(1]|[0-9]{3}[ .-]", value) and not re.fullmatch("[0-9]{13,19}", value):
        codes = ["1", "7", *map(str, [20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67),
                                      81, 82, 84, 86, *range(90, 96), 98])]
        kept = ""
        if value[0] in "+1":
            kept = next((c for c in codes if digits.startswith(c)), digits[:3])
        return filled(value, kept + brute_digits(digits[len(kept):], 10, "phone"))
    body = brute_digits(digits[:-1], 10, "card")
    return filled(value, body + next(c for c in "0123456789" if luhn(body + c)))


def test_pseudonyms_equal_a_network_written_without_spark(spark):
    values = [*ALONE, *(v for group in SPELLINGS for v in group)]
    assert changed(spark, [f"see {v} there" for v in values]) == [f"see {brute(v)} there" for v in values]


def test_permutation_has_no_collisions(spark):
    dates = spark.sql("SELECT id AS doc_id, date_format(date_add(DATE '1900-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS text "
                      "FROM range(0, 72900, 9)")
    out = ps.pseudonymised(dates, "key")
    assert out.select("text").distinct().count() == 8100
    assert out.where(F.try_to_date("text", "yyyy-MM-dd").isNull()).count() == 0


def test_what_is_no_value_stays(spark):
    assert changed(spark, NO_VALUES) == NO_VALUES


def test_odd_texts(odd, empty):
    rows = ps.pseudonymised(odd, "key")
    assert sorted(rows.columns) == sorted(odd.columns)
    got = Counter((r.doc_id, r.text) for r in rows.where("doc_id <> 16 OR doc_id IS NULL").collect())
    assert got == Counter(r for r in odd_texts() if r[0] != 16)
    row = rows.where("doc_id = 16").first()
    assert row.pseudonyms == {"phone": 1, "card": 1} and "4041894974608795" not in row.text
    assert ps.pseudonymised(empty, "key").count() == 0
    assert ps.pseudonymised(odd, "key", counts=None).schema["pseudonyms"].dataType.simpleString() == "string"


def test_pipeline_stages_keep_the_columns_and_the_right_rows(spark, odd, tmp_path):
    spark.createDataFrame([(4, 1), (6, 1), (10, 1), (13, 1)], "doc_id long, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = odd_texts()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.where("piece = 0").collect()) == sorted(
                (i is None, i or 0) for i, _ in rows)
            break
        assert out.columns == docs.columns
        if name == "exact_dedup":
            best = {}
            for i, t in rows:
                key = lower_az(t or "")
                best[key] = max([best.get(key, (i, t)), (i, t)], key=lambda r: -1 if r[0] is None else r[0])
            rows = list(best.values())
        if name == "ngram_join":
            component = {i: c for i, _, c in brute_components(rows, 5, 80)}
            rows = [r for r in rows if component[r[0]] in (r[0], None)]
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name == "pseudonyms":
            assert "4041894974608795" not in docs.where("doc_id = 16").first().text
            rows = [(i, t) if i != 16 else (i, docs.where("doc_id = 16").first().text) for i, t in rows]
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows)


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "op11_",
                                  "op12_", "op13_", "pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert len([q for q in entry.queries() if q.startswith(name)]) == 1
