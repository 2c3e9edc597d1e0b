import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from furlong.llm import pii, queries
from tests.llm.helpers import documents, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def keeps(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if keeps(kind, m[0])]


def base(text):
    return [s for s in pii.spans_of(text) if s[0] in pii.BASE]


CASES = [
    "", "a@b.c", "a@b", "@b.c", "a@b.c@d.e", "a@b@c.d", "x.a@b.c.d@e.f.", "é.a@b-c.de ü@x.y", "a@.b a@b..c a@b.c.", "%+-_@--.--",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3.4.5.6.7", "1.2.3", "1..2.3.4", "0001.02.0.255x", "256.1.1.1", "9" * 5000 + ".1.1.1", "1.2.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "x4111111111111111y", "4111111111111112", "0000 0000 0000 0",
    "12 4111 1111 1111 1111", "1" * 5000, "4 1-1 1-1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (377) 555-0271", "+1(2", "+12", "+123", "+1 2", "++123456789", "+1234567890123456", "+1 234 567 89 )", "+123456789+123456789", "+ 123456789",
    "+1 (377) 555-0271 10.0.0.1 4111111111111111 me+you@x.org", "٣.٣.٣.٣ ＋12345678901 a＠b.c", "𝔘𝔫 me@x.de 𝔘 1.1.1.1",
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute(text)


def test_base_spans_on_random_texts():
    rng = random.Random(3)
    for alphabet in ("ab@.-", "12.", "0145 -", "+12 ().-x", "a1@.+- \né("):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert base(text) == brute(text), text


@pytest.mark.parametrize("text, kind, value", [
    ("see https://user@host.org/a?b=1.", "url", "https://user@host.org/a?b=1"),
    ("(FTP://files.net)", "url", "FTP://files.net"),
    ("IBAN: DE89 3704 0044 0532 0130 00 bitte", "iban", "DE89 3704 0044 0532 0130 00"),
    ("iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
    ("Account no. 1234-5678 is", "account", "1234-5678"),
    ("passport number: X1234567", "account", "X1234567"),
])
def test_added_finds(text, kind, value):
    assert [text[s:e] for k, s, e in pii.spans_of(text) if k == kind] == [value]


@pytest.mark.parametrize("text", ["http://", "xhttp://a.b", "IBAN DE89 3704 0044 0532 0130 01", "accounting 12345678", "account of many", "account 12", "on account of 1234567 people", ""])
def test_nothing_to_find(text):
    assert not [s for s in pii.spans_of(text) if s[0] not in pii.BASE]


def test_mask_covers_overlapping_finds():
    text = "to ftp://me@x.org/1.2.3.4 or me@x.org!"
    assert pii.mask(text, pii.spans_of(text)) == "to [url] or [email]!"


def test_many_anchors_are_read_once():
    for part in ("1 ", "1.", "+1", "a@", "http://", "z"):
        assert base(part * 1500 + "@") == brute(part * 1500 + "@")
        assert len(pii.spans_of(part * 200_000 + "@ me@x.org")) >= 1  # the patterns would need minutes here


def test_query_on_awkward_rows(spark, monkeypatch):
    rows = documents() + [(2000 + i, t, "en", "s", 1, None, None, None, None) for i, t in enumerate(CASES)]
    docs = frame(spark, rows)
    monkeypatch.setattr(queries, "load", lambda *_: docs)
    got = sorted((tuple(r) for r in queries.QUERIES["op12_pii"](spark, "").collect()), key=repr)
    want = []
    for row in rows:
        text = row[1] or ""
        spans, plain = pii.spans_of(text), brute(text)
        join = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        want.append((row[0], *[sum(k == kind for k, _, _ in plain) for kind in pii.BASE],
                     hashlib.sha256(join(plain).encode()).hexdigest(), join(spans)))
    assert got == sorted(want, key=repr)


def test_masked_texts_and_clashing_columns(spark):
    docs = frame(spark).withColumn("spans", F.lit(1)).withColumn("masked", F.lit(2))
    found = pii.find(docs, masked=True)
    assert found.columns == docs.columns
    assert found.count() == docs.count()
    assert found.filter("text = 'x'").first().masked == "x"


def test_empty_table(spark):
    assert pii.find(frame(spark, [])).collect() == []
