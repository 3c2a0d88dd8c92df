"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame operations only.

A value that passes its kind's validation is permuted by a keyed Feistel network
over the values of its own format: a card number becomes another one with a right
check digit, a date another date, and so on; separators stay where they are.  The
same value always becomes the same pseudonym, so it stays linked across documents,
and with the key the change can be undone (``restore``).

| kind | what is validated | what is permuted |
|---|---|---|
| email | local part, domain with a dot | letters and digits of the local part, in chunks of 12 |
| card | 13 to 19 digits, check digit | all but the check digit, which is computed anew |
| phone | international, or 10 digits in 3-3-4 (a 1 before them is a country code) | the digits after the country code |
| ssn | area, group and serial in use | all nine digits, among valid numbers |
| ip | four numbers up to 255 | all 32 bits |
| date | a day from 1900 on | the day, among 72,900 from 1900-01-01 (up to 2099-08-04) |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "card", "phone", "ssn", "ip", "date")
ROUNDS = 8
#: Letters and digits permuted together: 36^12 and its halves fit a 64-bit number.
CHUNK = 12
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 270, 270
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What may be a value of each kind; none of them can run on from or into further digits.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?<![0-9.]){BYTE}\.{BYTE}\.{BYTE}\.{BYTE}(?![0-9]|\.[0-9])",
    "date": (r"(?<![0-9/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])"
             r"|(?<![0-9./-])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9/-]|\.[0-9])"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # International: an area and four pairs; groups of two or more digits; the same where another number follows, so
    # that it is 15 digits at most; any groups, 8 to 15 digits in all; the same with dots.  National: 3-3-4 digits.
    "phone": (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-][0-9]{2}){4}(?![0-9])"
              r"|(?<![0-9+])(?!\+(?:[ .()-]{0,2}[0-9]){16})"
              r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
              r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,3}\)|[0-9]{2,3})"
              r"(?:(?:[ .-]?[0-9]{2,3}){3}|(?:[ .-]?[0-9]{2,4}){2})(?![0-9])"
              r"|(?<![0-9+])\+[1-9](?:(?:[ -]|[ -]?\(|\)[ -]?)?[0-9]){7,14}(?![0-9])"
              r"|(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?[0-9](?:\.?[0-9]){6,11}(?![0-9])"
              r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
              r"|(?<![0-9+-])(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
              r"|(?<![0-9+-])(?<![0-9] )(?:1 )?[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9-]| [0-9])"),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}"
             r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
}
#: Country codes of one, two and three digits (fixed values of the international numbering plan); anything else is read
#: as it is grouped.  What is kept of a national number is a leading 1.
CODE = (r"^\+(?:[17]|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
        r"|^\+[0-9]{1,3}|^1(?=[ .-])")
SHAPE = "|".join(f"(?:{s})" for s in SHAPES.values())
#: A text without this holds no value of any kind: every shape needs one of these (phones with a country code the last).
HINT = r"@|[0-9]{4}|[0-9]\.[0-9]|\+[0-9]"


def _number(column: Column) -> Column:
    return column.cast("bigint")


def feistel(left: Column, right: Column, high: Column, low: Column, key: str, tweak: str, restore: bool) -> Column:
    """The pair permuted among pairs below (high, low), as a struct of l and r.

    Even rounds add a keyed hash of the right half to the left one, odd rounds the
    reverse, each modulo its own size; undoing subtracts in the other order.
    """

    def turn(state: Column, n: Column) -> Column:
        even = n % 2 == 0
        other = F.when(even, state["r"]).otherwise(state["l"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), n.cast("string"), other.cast("string"),
                                    high.cast("string"), low.cast("string")), 256)
        noise = _number(F.conv(F.substring(digest, 1, 15), 16, 10))
        noise = -(noise % F.when(even, high).otherwise(low)) if restore else noise
        return F.struct(F.when(even, F.pmod(state["l"] + noise % high, high)).otherwise(state["l"]).alias("l"),
                        F.when(even, state["r"]).otherwise(F.pmod(state["r"] + noise % low, low)).alias("r"))

    rounds = range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(n) for n in rounds]), F.struct(_number(left).alias("l"), _number(right).alias("r")),
                       turn)


def _power(radix: int, exponent: Column) -> Column:
    """radix ** exponent as an exact 64-bit number."""
    table = F.array(*[F.lit(radix ** i).cast("bigint") for i in range(19 if radix == 10 else CHUNK + 1)])
    return F.element_at(table, exponent + 1)


def permuted(symbols: Column, radix: int, key: str, tweak: str, restore: bool) -> Column:
    """A string of digits of ``radix`` (10 or 36, lower case) permuted among those of its length; one of 0 or 1 symbol
    is a single half."""
    size = F.length(symbols)
    first = F.floor(size / 2).cast("int")
    decimal = (lambda s: _number(F.coalesce(F.conv(F.when(F.length(s) > 0, s).otherwise("0"), radix, 10), F.lit("0"))))
    done = feistel(decimal(symbols.substr(F.lit(1), first)), decimal(symbols.substr(first + 1, size)),
                   _power(radix, first), _power(radix, size - first), key, tweak, restore)
    shown = (lambda n, width: F.when(width > 0, F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), width, F.lit("0"))).otherwise(""))
    # The halves are read from a struct that is computed once.
    both = F.transform(F.array(done), lambda d: F.concat(shown(d["l"], first), shown(d["r"], size - first)))
    return both[0]


def _filled(template: Column, symbols: Column, kind: str) -> Column:
    """The template with its characters of class ``kind`` replaced in turn."""

    def put(state: Column, ch: Column) -> Column:
        hit = ch.rlike(kind)
        return F.struct(F.concat(state["out"], F.when(hit, symbols.substr(state["i"], F.lit(1))).otherwise(ch)).alias("out"),
                        (state["i"] + F.when(hit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), put,
                       lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str, restore: bool) -> Column:
    digits = _digits(value)
    body = permuted(digits.substr(F.lit(1), F.length(digits) - 1), 10, key, "card", restore)
    whole = F.transform(F.array(body), lambda b: F.concat(b, F.filter(
        F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(b, d)))[0]))[0]
    return F.when(F.call_function("luhn_check", digits), _filled(value, whole, "[0-9]"))


def _phone(value: Column, key: str, restore: bool) -> Column:
    head = F.regexp_extract(value, CODE, 0)
    rest = value.substr(F.length(head) + 1, F.length(value))
    size = F.length(_digits(value))
    return F.when((size >= 8) & (size <= 15), F.concat(head, _filled(
        rest, permuted(_digits(rest), 10, key, "phone", restore), "[0-9]")))


def _ssn(value: Column, key: str, restore: bool) -> Column:
    area, group, serial = (_number(value.substr(F.lit(a), F.lit(n))) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    done = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key,
                   "ssn", restore)
    shown = F.transform(F.array(done), lambda d: F.format_string(
        "%03d-%02d-%04d", F.floor(d["l"] / 99) + 1 + F.when(F.floor(d["l"] / 99) >= 665, 1).otherwise(0),
        d["l"] % 99 + 1, d["r"] + 1))[0]
    return F.when(valid, shown)


def _ip(value: Column, key: str, restore: bool) -> Column:
    part = (lambda i: _number(F.split_part(value, F.lit("."), F.lit(i))))
    size = F.lit(1 << 16).cast("bigint")
    done = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), size, size, key, "ip", restore)
    return F.transform(F.array(done), lambda d: F.format_string(
        "%d.%d.%d.%d", F.floor(d["l"] / 256), d["l"] % 256, F.floor(d["r"] / 256), d["r"] % 256))[0]


def _date(value: Column, key: str, restore: bool) -> Column:
    dashed, dotted = value.contains("-"), value.contains(".")
    iso, dots = F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd.MM.yyyy")
    day_first, month_first = (F.try_to_date(value, p) for p in ("dd/MM/yyyy", "MM/dd/yyyy"))
    # A day above 12 shows the order; otherwise it is day first, and pseudonyms keep to that order.
    day_order = F.substring(value, 4, 2) <= "12"
    day = F.when(dashed, iso).when(dotted, dots).when(day_order, day_first).otherwise(month_first)
    place = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    done = feistel(F.floor(place / DAYS_LOW), place % DAYS_LOW, F.lit(DAYS_HIGH).cast("bigint"),
                   F.lit(DAYS_LOW).cast("bigint"), key, "date", restore)
    new = F.transform(F.array(done), lambda d: F.date_add(
        F.lit(FIRST_DAY).cast("date"), (d["l"] * DAYS_LOW + d["r"]).cast("int")))[0]
    return F.when((place >= 0) & (place < DAYS_HIGH * DAYS_LOW),
                  F.when(dashed, F.date_format(new, "yyyy-MM-dd")).when(dotted, F.date_format(new, "dd.MM.yyyy"))
                  .otherwise(F.date_format(new, "dd/MM/yyyy")))


def _email(value: Column, key: str, restore: bool) -> Column:
    local = F.lower(F.split_part(value, F.lit("@"), F.lit(1)))
    plain = F.regexp_replace(local, "[^a-z0-9]", "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1)), F.lit(CHUNK))
    new = F.array_join(F.transform(starts, lambda a: permuted(plain.substr(a, F.lit(CHUNK)), 36, key, "email", restore)), "")
    return F.when(F.length(plain) > 0, F.concat(_filled(local, new, "[a-z0-9]"), F.lit("@"),
                                                F.split_part(value, F.lit("@"), F.lit(2))))


def _kind(value: Column) -> Column:
    """Which shape a match has; the shapes exclude each other."""
    return (F.when(value.contains("@"), "email").when(value.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$"), "ip")
            .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/|^[0-9]{2}\.[0-9]{2}\."), "date")
            .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(value.rlike(r"^\+|^\(|^1[ .-]|^[0-9]{3}[ .-]"), "phone").otherwise("card"))


def pseudonym(value: Column, key: str, restore: bool = False) -> Column:
    """(kind, new) of a match: ``new`` is NULL if the value does not pass its kind's validation."""
    made = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}
    kind, new = _kind(value), F.lit(None).cast("string")
    for name in KINDS:
        new = F.when(kind == name, made[name](value, key, restore)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", restore: bool = False,
                  counts: str | None = "pseudonyms") -> DataFrame:
    """All columns, with pseudonyms in ``text``, and ``counts``: how many of each kind (a map; none if None).

    A column named as ``counts`` is replaced.  Texts without any value, empty and
    NULL ones stay as they are, with an empty map.  What looks like a value but is
    none stays.  Dates with slashes are read day first unless the second number is
    above 12, and written day first; dates with dots are day first.  Emails are compared and written in lower case
    before the @.  Equal rows get equal results; an empty table gives no rows.
    """
    whole = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text"))
    maybe = F.coalesce(whole.rlike(HINT), F.lit(False))
    rows = rows.withColumn("found", F.when(maybe, F.regexp_extract_all(whole, F.lit(SHAPE), F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    rows = rows.withColumn("new", F.transform("found", lambda m: pseudonym(m, key, restore)))
    shown = F.zip_with(F.split(whole, SHAPE, -1), F.zip_with("new", "found", lambda n, m: F.coalesce(n["new"], m)),
                       lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    changed = F.when(F.size("found") > 0, F.array_join(shown, "")).otherwise(whole)
    kinds = F.transform(F.filter("new", lambda n: n["new"].isNotNull()), lambda n: n["kind"])
    many = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(
        k, F.size(F.filter(kinds, lambda x: x == k)).cast("bigint"))))
    out = [changed.alias(n) if n == text else F.col(f"doc.`{n}`") for n in docs.columns if n != counts]
    return rows.select(*out, *([many.alias(counts)] if counts else []))
