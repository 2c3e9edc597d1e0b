"""Text-to-value column builders for fixed-width records (no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_BLANKS = "[" + WHITESPACE + "]*"
# The same below U+0080: a class of such characters is one bitmap, a wider one a chain of tests.
_ASCII_BLANKS = "[" + "".join(c for c in WHITESPACE if c < "\x80") + "]*"
_DECIMAL = "[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMBER = f"^{_BLANKS}{_DECIMAL}{_BLANKS}$"
ASCII_NUMBER = f"^{_ASCII_BLANKS}{_DECIMAL}{_ASCII_BLANKS}$"
#: What may be a whole number, with the blanks and control characters that a cast ignores around it.
_IGNORED = "[" + "".join(map(chr, [*range(1, 33), 127])) + "\\x00]*"
WHOLE = f"^{_IGNORED}[+-]?[0-9]+{_IGNORED}$"
YMD = rf"^{_BLANKS}(?!0000)[0-9]{{8}}{_BLANKS}$"


def chars(line: Column, start: int, end: int) -> Column:
    """Characters ``start`` (0-based) up to but excluding ``end``."""
    return F.substring(line, start + 1, end - start)


def strip(text: Column) -> Column:
    """Without surrounding whitespace of any kind (plain blanks first: that trim is fast)."""
    return F.btrim(F.trim(text), F.lit(WHITESPACE))


def wide(text: Column) -> Column:
    """Stripped name with the inner full-width spaces removed."""
    return F.replace(strip(text), F.lit("\u3000"), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def to_int(text: Column) -> Column:
    """Whole number or NULL; blanks around it are ignored.

    The strict cast refuses fractions, words and too long numbers by itself,
    but raises an exception inside each time, so that only what looks like a
    number reaches it.
    """
    plain = strip(text)
    return F.when(plain.rlike(WHOLE), plain.try_cast("bigint"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def is_number(text: Column) -> Column:
    """True for a plain decimal number, blanks around it allowed; words, type suffixes (``1d``) and hexadecimal are not."""
    return F.when(is_ascii(text), text.rlike(ASCII_NUMBER)).otherwise(text.rlike(NUMBER))


def plain_float(text: Column) -> Column:
    """The cast of text that ``is_number``. It drops blanks below U+0021 by itself; others are longer than a byte."""
    return F.when(is_ascii(text), text).otherwise(F.btrim(text, F.lit(WHITESPACE))).try_cast("double")


def to_float(text: Column) -> Column:
    """Decimal number or NULL. Only what looks like a number reaches the cast, once."""
    return F.when(is_number(text), plain_float(text))


def to_ymd(text: Column) -> Column:
    return F.when(text.rlike(YMD), F.try_to_timestamp(strip(text), F.lit("yyyyMMdd")).cast("date"))


def to_tenths(text: Column) -> Column:
    """Whole tenths as a double; zero means "not recorded"."""
    return F.nullif(to_int(text), F.lit(0).cast("bigint")) / F.lit(10.0)


def signed_change(text: Column) -> Column:
    """Weight change such as ``+10`` or ``- 4``."""
    return to_int(F.replace(strip(text), F.lit("+"), F.lit("")))


def full_year(two_digits: Column) -> Column:
    """00-50 are the 2000s, everything above the 1900s."""
    return two_digits + F.when(two_digits <= 50, F.lit(2000)).otherwise(F.lit(1900))


def lookup(code: Column, mapping: dict[str, str]) -> Column:
    """Label for a code, NULL when the code is unknown."""
    pairs = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*pairs), code)


def race_key_parts(key: Column) -> dict[str, Column]:
    """Venue(2) year(2) meeting(1) day(1) race(2) of an eight-character key."""
    def number(start: int, end: int) -> Column:
        return chars(key, start, end).try_cast("bigint")

    return {
        "venue_code": chars(key, 0, 2),
        "year": full_year(number(2, 4)),
        "meeting": number(4, 5),
        "day": number(5, 6),
        "race_number": number(6, 8),
    }


def bad_race_key(key: Column) -> Column:
    """True unless the key has eight characters and all parts after the venue are digits."""
    return ~F.coalesce(key.rlike("^.{2}[0-9]{6}$"), F.lit(False))


def run_key(horse_id: Column, race_date: Column) -> Column:
    """Horse id followed by the date as YYYYMMDD."""
    return F.concat(horse_id, F.date_format(race_date, "yyyyMMdd"))


def run_key_parts(key: Column) -> dict[str, Column]:
    return {"horse_id": blank_to_null(chars(key, 0, 8)), "race_date": to_ymd(chars(key, 8, 16))}


def meeting_key(race_key: Column) -> Column:
    return chars(race_key, 0, 6)


def direction(code: Column) -> Column:
    return F.when(code == "1", "right").when(code == "2", "left").otherwise("straight")


def grade(code: Column) -> Column:
    return (
        F.when(code == "1", "G1").when(code == "2", "G2").when(code == "3", "G3")
        .when(code == "5", "Listed")
    )


def race_class(grade_code: Column, condition: Column) -> Column:
    """Grade if there is one, else the condition code with OP spelled out."""
    return F.coalesce(grade(grade_code), F.when(condition == "OP", "Open").otherwise(condition))


def field_size(tail: Column) -> Column:
    """Number of runners from the end of a programme record."""
    found = F.regexp_extract(strip(tail), r"([0-9]{1,2})[ ]?([0-9]{1,2})(?:[^0-9]*)$", 1)
    return blank_to_null(found).try_cast("bigint")
