"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates that pass their validation are replaced by another value of the
same format: a payment card number with a valid check digit by one with a valid
check digit, an IPv4 address by an IPv4 address, a telephone number by one of the
same shape, a calendar date by a calendar date in the same notation, a social
security number likewise.  E-mail addresses keep their shape: letters stay letters of their
case, digits stay digits.  Of a date with slashes the day is read first where that gives a date, else the month;
a date read month first is permuted among those that can only be read so.  Telephone numbers with and without
the country's code 1 have linked pseudonyms.  Octets with leading zeros are no IPv4 address.  IBANs
and national forms other than those below are left as they are.

A value of ``a * b`` possible ones is a pair (x in Z_a, y in Z_b); each round adds
a keyed hash of one half to the other.  Every round can be undone, so the
permutation is one to one, and it depends on key, kind and value alone: equal
values get equal pseudonyms in all documents and stay linked without any shared
state.  :func:`restore` undoes it for who has the key.  The key is a literal of the plan: who may see plans may undo it.

All of it is SQL functions: one pass, no shuffle.  Defined cases: a null text stays
null and has no matches; text without matches is returned as it is; what fails its
validation stays; an empty table stays empty; further columns are carried through by
:func:`pseudonymise`; repeated rows and ties get the same text each; very long texts are read whole.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import replace_matches

ROUNDS = 8

# What each kind looks like.  A match of one is never part of a longer run of digits.
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])|(?<![0-9])[3-6][0-9]{12,18}(?![0-9])"
PHONE = r"(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])|\+[1-9][0-9]{9,13}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9]|[./][0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, CARD, PHONE, SSN, IPV4, DATE))
KINDS = ["email", "card", "phone", "ssn", "ipv4", "date"]
#: Dates from FIRST_DAY on, 270 * 271 days, are permuted among themselves.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (270, 271)
#: So many dates from FIRST_DAY on whose day is after the twelfth are permuted among themselves.
LATE_DAYS = (210, 210)


def _hash(key: str, tag: Column, i: Column, half: Column, modulus: int) -> Column:
    """A keyed number in Z_modulus."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(modulus))


def permute(value: Column, a: int, b: int, key: str, tag: Column, inverse: bool = False) -> Column:
    """A keyed permutation of Z_(a*b), or its inverse."""
    low = value.cast("long") % b
    start = F.struct(F.round((value.cast("long") - low) / b).cast("long").alias("x"), low.cast("long").alias("y"))

    def step(s: Column, i: Column) -> Column:
        if inverse:
            y = F.pmod(s["y"] - _hash(key, tag, i * 2 + 1, s["x"], b), F.lit(b))
            return F.struct(F.pmod(s["x"] - _hash(key, tag, i * 2, y, a), F.lit(a)).alias("x"), y.alias("y"))
        x = F.pmod(s["x"] + _hash(key, tag, i * 2, s["y"], a), F.lit(a))
        return F.struct(x.alias("x"), F.pmod(s["y"] + _hash(key, tag, i * 2 + 1, x, b), F.lit(b)).alias("y"))

    rounds = F.sequence(F.lit(ROUNDS // 2 - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1))
    return F.aggregate(rounds, start, step, lambda s: s["x"] * b + s["y"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def pour(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order by those given."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    done = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(chars, done, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of the digits, every second one doubled; the first doubled is the so-manieth from the right (0 or 1)."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(F.pmod(n - i, F.lit(2)) == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _number(digits: Column, n: int, key: str, kind: str, inverse: bool) -> Column:
    """n digits permuted among all of n digits."""
    a, b = 10 ** (n // 2), 10 ** (n - n // 2)
    return F.lpad(permute(digits.cast("long"), a, b, key, F.lit(kind), inverse).cast("string"), n, "0")


def _card(m: Column, key: str, inverse: bool) -> Column:
    """All digits of sixteen but the last are permuted; of other numbers the first two stay, as they say what it is."""
    d = digits_of(m)
    payload = _number(F.substring(d, 1, 15), 15, key, "card", inverse)
    for n in (13, 14, 15, 17, 18, 19):
        other = F.concat(F.substring(d, 1, 2), _number(F.substring(d, 3, n - 3), n - 3, key, "card", inverse))
        payload = F.when(F.length(d) == n, other).otherwise(payload)
    check = F.pmod(10 - luhn_sum(payload, 0) % 10, F.lit(10)).cast("string")
    return pour(m, F.concat(payload, check))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    d = digits_of(m)
    code = F.when(m.startswith("+"), F.substring(d, 1, 1)).otherwise("")  # the first digit of the country's code stays
    rest = F.when(m.startswith("+"), F.substring(d, 2, 20)).otherwise(d)
    out = F.lit(None).cast("string")
    for n in range(9, 14):
        out = F.when(F.length(rest) == n, _number(rest, n, key, "phone", inverse)).otherwise(out)
    return pour(m, F.concat(code, out))


def _ipv4(m: Column, key: str, inverse: bool) -> Column:
    part = F.split(m, r"\.")
    value = F.aggregate(part, F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long"))
    new = permute(value, 1 << 16, 1 << 16, key, F.lit("ipv4"), inverse)
    return F.aggregate(F.array(new), F.lit(""), lambda s, v: F.concat_ws(".", *[F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)]))


def _date(m: Column) -> Column:
    iso, d = m.contains("-"), digits_of(m)
    ymd = F.when(iso, d).otherwise(F.concat(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))
    return F.try_to_timestamp(ymd, F.lit("yyyyMMdd")).cast("date")


def _day(m: Column) -> Column:
    return F.datediff(_date(m), F.lit(FIRST_DAY))


def _new_date(m: Column, key: str, inverse: bool) -> Column:
    day = F.date_add(F.lit(FIRST_DAY), permute(_day(m), *DAYS, key, F.lit("date"), inverse).cast("int"))
    return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(pour(m, F.date_format(day, "ddMMyyyy")))


def _late_day(m: Column) -> Column:
    """The number of a date, month first, among the dates whose day is after the twelfth; null for others."""
    d = digits_of(m)
    date = F.try_to_timestamp(F.concat(F.substring(d, 5, 4), F.substring(d, 1, 4)), F.lit("yyyyMMdd")).cast("date")
    months = (F.year(date) - FIRST_DAY.year) * 12 + F.month(date) - 1
    return F.when(m.contains("/") & (F.dayofmonth(date) > 12), F.datediff(date, F.lit(FIRST_DAY)) - 12 * months - 12)


def _new_late_date(m: Column, key: str, inverse: bool) -> Column:
    first = lambda i: F.add_months(F.lit(FIRST_DAY), i)
    before = lambda i: F.datediff(first(i), F.lit(FIRST_DAY)) - 12 * i

    def date_of(n: Column, about: Column) -> Column:  # about: the month, or one beside it
        month = F.when(before(about + 1) <= n, about + 1).when(before(about) <= n, about).otherwise(about - 1)
        return F.transform(F.array(month), lambda i: F.date_add(first(i), (n - before(i) + 12).cast("int")))[0]

    new = F.array(permute(_late_day(m), *LATE_DAYS, key, F.lit("late date"), inverse))
    date = F.transform(new, lambda n: date_of(n, F.floor(n / (365.2425 / 12 - 12)).cast("int")))[0]
    return pour(m, F.date_format(date, "MMddyyyy"))


def _shift(text: Column, other: Column, key: str, i: Column, back: bool) -> Column:
    """Every letter or digit moved within its class by a keyed hash of the other half, of its place and of the round."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def move(c: Column, at: Column) -> Column:
        out = c
        for letters in classes:
            place = F.instr(F.lit(letters), c) - 1
            by = _hash(key, F.concat_ws("|", F.lit("email"), at.cast("string")), i, other, len(letters))
            new = F.pmod(place - by if back else place + by, F.lit(len(letters)))
            out = F.when(place >= 0, F.lit(letters).substr((new + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(chars, move), "")


def _email(m: Column, key: str, inverse: bool) -> Column:
    """The part before the @, permuted within its shape; the domain stays, as it names no person."""
    name = F.substring_index(m, "@", 1)
    half = (F.length(name) / 2).cast("int")
    start = F.struct(name.substr(F.lit(1), half).alias("x"), name.substr(half + 1, F.length(name)).alias("y"))

    def step(s: Column, i: Column) -> Column:
        if inverse:
            y = _shift(s["y"], s["x"], key, i * 2 + 1, True)
            return F.struct(_shift(s["x"], y, key, i * 2, True).alias("x"), y.alias("y"))
        x = _shift(s["x"], s["y"], key, i * 2, False)
        return F.struct(x.alias("x"), _shift(s["y"], x, key, i * 2 + 1, False).alias("y"))

    rounds = F.sequence(F.lit(1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(1))
    new = F.aggregate(rounds, start, step, lambda s: F.concat(s["x"], s["y"]))
    return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its validation, else null."""
    octets = F.size(F.filter(F.split(m, r"\."), lambda p: p.rlike("^(?:0|[1-9][0-9]*)$") & (p.cast("int") <= 255)))
    day = _day(m)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(rf"^(?:{CARD})$"), F.when(luhn_sum(digits_of(m), 1) % 10 == 0, F.lit("card")))
        .when(m.rlike(rf"^(?:{PHONE})$"), F.lit("phone"))
        .when(m.rlike(rf"^(?:{SSN})$"), F.when(~m.rlike("^(?:000|666|9)") & ~m.contains("-00-") & ~m.endswith("-0000"), F.lit("ssn")))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets == 4, F.lit("ipv4")))
        .when(day.between(0, DAYS[0] * DAYS[1] - 1), F.lit("date"))
        .when(_late_day(m).between(0, LATE_DAYS[0] * LATE_DAYS[1] - 1), F.lit("late date"))
    )


def _new_value(m: Column, key: str, inverse: bool) -> Column:
    kind = kind_of(m)
    return (
        F.when(kind == "email", _email(m, key, inverse))
        .when(kind == "card", _card(m, key, inverse))
        .when(kind == "phone", _phone(m, key, inverse))
        .when(kind == "ssn", pour(m, _number(digits_of(m), 9, key, "ssn", inverse)))
        .when(kind == "ipv4", _ipv4(m, key, inverse))
        .when(kind == "date", _new_date(m, key, inverse))
        .when(kind == "late date", _new_late_date(m, key, inverse))
        .otherwise(m)
    )


def may_hold_any(text: Column) -> Column:
    """True of every text with a match of ANY: it has an @ or seven characters of a number."""
    return text.contains("@") | text.rlike(r"[0-9][0-9 ().+/-]{5}")


def pseudonym_text(text: Column, key: str) -> Column:
    return replace_matches(text, ANY, lambda m: _new_value(m, key, False), may_hold_any(text))


def restored_text(text: Column, key: str) -> Column:
    return replace_matches(text, ANY, lambda m: _new_value(m, key, True), may_hold_any(text))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts."""
    return docs.withColumn(text_column, pseudonym_text(F.col(text_column), key))


def restore(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The documents as they were before :func:`pseudonymise` with the same key."""
    return docs.withColumn(text_column, restored_text(F.col(text_column), key))


def found_values(text: Column) -> Column:
    """Array of (kind, value) of what is replaced."""
    found = F.when(may_hold_any(text) & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"))), lambda s: s["kind"].isNotNull())
