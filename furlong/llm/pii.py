"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs and digits that touch, URL schemes and words that
announce an identifier. A parser of its own for each kind expands an anchor to both sides, character by character, and
validates what it found. A parser never looks behind the end of its last find, so a text is read once however many
anchors it has, and finds of a kind never overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import give_back, text_of

#: Kinds of finds in the order they are listed. The first four are the plain ones, the others the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | LETTERS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
#: What ends a URL, and what is not part of one at its end.
URL_END = frozenset(" \t\n\x0b\x0c\r<>\"'`{}|\\^")
URL_TAIL = frozenset(".,;:!?)]")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
#: Words that announce an account or another identifier of a person, and words that may stand between them and it.
CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "customer id", "user id")
BETWEEN = ("number", "nummer", "numero", "numéro", "no", "nr", "num", "id", "is")
FILLER = frozenset(" \t:#.=")


def run_end(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of ``allowed`` characters that starts at ``at``."""
    size = len(text)
    while at < size and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, floor: int, allowed: frozenset) -> int:
    """Start of the run of ``allowed`` characters that ends before ``at``, not before ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


# Each parser takes the text, the first character of its anchor, the one behind it and the end of the kind's last find or
# rejected run. It returns the finds and the position before which the kind is settled.


def email(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    start = run_start(text, at, floor, LOCAL)
    stop = run_end(text, end, LABEL)
    if start == at or stop == end:
        return [], floor
    labels = 0
    while stop < len(text) and text[stop] == ".":
        following = run_end(text, stop + 1, LABEL)
        if following == stop + 1:
            break
        stop, labels = following, labels + 1
    return ([("email", start, stop)], stop) if labels else ([], floor)


def ip(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    """Of a chain of numbers joined by dots, each four in turn."""
    start = run_start(text, at + 1, floor, DIGITS)
    parts = []
    while True:
        stop = run_end(text, start, DIGITS)
        parts.append((start, stop))
        if text[stop:stop + 1] != "." or text[stop + 1:stop + 2] not in DIGITS:
            break
        start = stop + 1
    found = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        values = [text[a:b].lstrip("0") for a, b in four]
        if all(len(v) <= 3 and int(v or "0") <= 255 for v in values):
            found.append(("ip", four[0][0], four[3][1]))
    return found, stop


def card(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    """The whole chain of digits with at most one blank or hyphen between neighbours."""
    start, stop = at, at + 1
    while True:
        if text[stop:stop + 1] in DIGITS:
            stop += 1
        elif text[stop:stop + 1] in (" ", "-") and text[stop + 1:stop + 2] in DIGITS:
            stop += 2
        else:
            break
    # no longer number is a card, so a longer chain needs no copy
    digits = text[start:stop].replace(" ", "").replace("-", "") if stop - start < 40 else ""
    return [("card", start, stop)] if 13 <= len(digits) <= 19 and luhn(digits) else [], stop


def phone(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    over = run_end(text, end, DIALLED)
    stop = over
    while stop > end and text[stop - 1] not in DIGITS:
        stop -= 1
    if stop < end + 2:
        return [], floor
    digits = sum(c in DIGITS for c in text[at:stop])
    return [("phone", at, stop)] if 9 <= digits <= 15 else [], stop


def url(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    """Scheme, a host with an optional name before an at-sign, and whatever follows up to white space or a quote."""
    if at > floor and text[at - 1] in ALNUM:
        return [], floor
    stop = end
    while stop < len(text) and text[stop] not in URL_END:
        stop += 1
    over = stop
    while stop > end and text[stop - 1] in URL_TAIL:
        stop -= 1
    host = end
    while host < stop and text[host] not in "/?#":
        host += 1
    name = text.rfind("@", end, host) + 1 or end
    return [("url", at, stop)] if run_end(text, name, LABEL) > name else [], over


def iban(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    """The longest run of groups behind the cue that passes the check digits."""
    start = run_end(text, skip_words(text, end), FILLER)
    stop, code, best = start, "", None
    while True:
        following = run_end(text, stop, ALNUM)
        code += text[stop:following]
        if following == stop or len(code) > 34:
            break
        stop = following
        if len(code) >= 15 and code[:2].isalpha() and code[2:4].isdigit() and mod97(code):
            best = stop
        if text[stop:stop + 1] != " ":
            break
        stop += 1
    return ([("iban", start, best)], best) if best else ([], floor)


def account(text: str, at: int, end: int, floor: int) -> tuple[list, int]:
    """Six to twenty letters and digits behind the cue, at least four of them digits."""
    if (at > 0 and text[at - 1] in ALNUM) or text[end:end + 1] in ALNUM:
        return [], floor
    start = run_end(text, skip_words(text, end), FILLER)
    stop = run_end(text, start, LABEL)
    while stop > start and text[stop - 1] == "-":
        stop -= 1
    code = text[start:stop].replace("-", "") if stop - start <= 40 else ""
    good = start > end and 6 <= len(code) <= 20 and sum(c in DIGITS for c in code) >= 4
    return ([("account", start, stop)], stop) if good else ([], floor)


def skip_words(text: str, at: int) -> int:
    """Position behind blanks and a word that may stand before an identifier."""
    start = run_end(text, at, FILLER)
    for word in BETWEEN:
        stop = start + len(word)
        if text[start:stop].lower() == word and text[stop:stop + 1] not in LETTERS and text[stop:stop + 1]:
            return stop
    return at


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url, "iban": iban, "account": account}


def spellings(word: str) -> set[str]:
    return {word, word.capitalize(), word.upper()}


@cache
def automaton():
    """The anchors: a few hundred short words, made from the digits and the lists above."""
    import ahocorasick

    anchors = {"@": "email"}
    digits = sorted(DIGITS)
    anchors |= {f"+{d}": "phone" for d in digits}
    anchors |= {f"{a}.{b}": "ip" for a in digits for b in digits}
    anchors |= {f"{a}{gap}{b}": "card" for a in digits for b in digits for gap in ("", " ", "-")}
    for kind, words in (("url", SCHEMES), ("iban", ("iban",)), ("account", CUES)):
        anchors |= {spelling: kind for word in words for spelling in spellings(word)}
    built = ahocorasick.Automaton()
    for anchor, kind in anchors.items():
        built.add_word(anchor, (len(anchor), kind))
    built.make_automaton()
    return built


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All finds of a text: (kind, start, end) by kind, then start; positions are code points, the end exclusive."""
    settled = dict.fromkeys(KINDS, 0)
    found: dict[str, list] = {kind: [] for kind in KINDS}
    for last, (length, kind) in automaton().iter(text):
        start = last + 1 - length
        if start >= settled[kind]:
            new, settled[kind] = PARSERS[kind](text, start, last + 1, settled[kind])
            found[kind] += new
    return [span for kind in KINDS for span in found[kind]]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each find, overlapping ones together, replaced by its kind in brackets."""
    pieces, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= done:
            pieces += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*pieces, text[done:]])


def find(docs: DataFrame, text: str = "text", masked: bool = False) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end), and with ``masked`` also that text without its finds.

    Spans are listed by kind in the order of ``KINDS``, then by start; finds of different kinds may overlap. A null text
    counts as empty and has none. Whole texts are read in one pass each, whatever their length; equal rows get equal
    answers. Existing columns ``spans`` and ``masked`` are replaced, any other names do no harm.
    """
    spans = "spans array<struct<kind:string,start:long,end:long>>"

    @F.arrow_udf(f"{spans}, masked string" if masked else spans)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lists, clean = [], []
            for item in texts:
                value = item.as_py()
                found = spans_of(value)
                lists.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                if masked:
                    clean.append(mask(value, found))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(lists, kind), *([pa.array(clean, pa.string())] if masked else [])]
            yield pa.StructArray.from_arrays(arrays, names=["spans", "masked"][:len(arrays)])
        give_back()

    found = docs.withColumn("spans", scan(text_of(text)))
    if masked:
        found = found.withColumn("masked", F.col("spans.masked"))
    return found.withColumn("spans", F.col("spans.spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))
