"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. Each anchor
goes to a local parser that expands it to both sides within its character class and validates what it found. The base
kinds email, ip, card and phone equal the leftmost non-overlapping matches of their patterns (module tests hold them
against the patterns); the kinds url, account (an IBAN with a right check sum, or a number behind an account cue) and
secret (a value behind a cue, or an access-key id) are added.

Defined results: null texts count as empty; the empty text has no spans; spans of different kinds may overlap; spans
are sorted by kind and start; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import map_text, narrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DIGIT = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`|\\^{}")
SCHEMES = ("http://", "https://", "ftp://", "ws://", "wss://", "ssh://", "s3://")
ACCOUNT_CUES = ("iban", "account", "acct", "a/c")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_ACCOUNT, MAX_ACCOUNT = 6, 20

Span = tuple[int, int]


def _automaton() -> ahocorasick.Automaton:
    """Over lower-cased text; digits are found by a pattern, as runs."""
    found = ahocorasick.Automaton()
    for kind, words in (("email", "@"), ("phone", "+"), ("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("key", ("akia", "ghp_", "xoxb-"))):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for digit in DIGIT:
        found.add_word(digit, ("digit", 1))
    found.make_automaton()
    return found


_anchors = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, at: int, chars: frozenset) -> int:
    """The end of the run of ``chars`` from ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at``, not before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    whole = None
    while end < len(text) and text[end] == ".":
        further = _run(text, end + 1, LABEL)
        if further == end + 1:
            break
        whole = end = further
    return (start, whole) if whole else None


def ip_at(text: str, at: int) -> tuple[Span | None, int]:
    """The dotted quad whose first digit is at ``at``: (span or None, where the search goes on)."""
    end = _run(text, at, DIGIT)
    first, to = end, end
    for _ in range(3):
        further = _run(text, to + 1, DIGIT) if to < len(text) and text[to] == "." else to
        if further <= to + 1:
            return None, first
        to = further
    parts = text[at:to].split(".")
    return ((at, to) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts) else None), to


def card_at(text: str, at: int) -> tuple[Span | None, int]:
    """The digit group that starts at ``at``."""
    end, n, digits = at + 1, len(text), 1
    while True:
        if end < n and text[end] in DIGIT:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGIT:
            end += 2
        else:
            break
        digits += 1
    if digits < 2:
        return None, at + 1
    return ((at, end) if 13 <= digits <= 19 and luhn(text[at:end].replace(" ", "").replace("-", "")) else None), end


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    """The number behind the plus sign at ``at``."""
    if at + 1 >= len(text) or text[at + 1] not in DIGIT:
        return None, at + 1
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGIT:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGIT:
        return None, at + 1
    digits = sum(c in DIGIT for c in text[at:end])
    return ((at, end) if 9 <= digits <= 15 else None), end


def url_at(text: str, start: int, behind: int) -> Span | None:
    """The URL whose scheme is text[start:behind]."""
    if start and text[start - 1] in ALNUM:
        return None
    end, n = behind, len(text)
    while end < n and text[end] not in URL_END:
        end += 1
    while end > behind and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > behind and text[behind] in ALNUM else None


def iban(value: str) -> bool:
    """Country, check digits and remainder 1 modulo 97."""
    value = value.replace(" ", "").upper()
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value[2:4].isdigit() or not all(c in ALNUM for c in value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


_cue_value = re.compile(r"[\s:#=.\"'-]{1,6}(?:(?:no|nr|number|is)\b[\s:#=.\"'-]{0,4})?", re.I | re.A)
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", re.A)
_secret = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/.-]{8,})", re.A)


def account_at(text: str, behind: int) -> Span | None:
    """The account number behind a cue that ends at ``behind``."""
    gap = _cue_value.match(text, behind)
    if not gap:
        return None
    at = gap.end()
    if found := _iban.match(text, at):
        end = found.end()
        while end - at >= 15:
            if text[end - 1] != " " and iban(text[at:end]):
                return at, end
            end -= 1
    end = at
    while end < len(text) and (text[end] in DIGIT or text[end] in " -" and end > at and text[end - 1] in DIGIT and end + 1 < len(text) and text[end + 1] in DIGIT):
        end += 1
    return (at, end) if MIN_ACCOUNT <= sum(c in DIGIT for c in text[at:end]) <= MAX_ACCOUNT else None


def secret_at(text: str, behind: int) -> Span | None:
    found = _secret.match(text, behind)
    return found.span(1) if found else None


def key_at(text: str, start: int, behind: int) -> Span | None:
    """An access-key id: a known prefix and at least 16 letters and digits."""
    if start and text[start - 1] in ALNUM or text[start:behind].isalpha() and not text[start:behind].isupper():
        return None
    end = _run(text, behind, ALNUM)
    return (start, end) if end - behind >= 16 else None


def _lower(text: str) -> str:
    """ASCII lower case: as many characters as before."""
    return text.lower() if text.isascii() else text.translate(_fold)


_fold = {c: c + 32 for c in range(65, 91)}


def spans(text: str | None) -> dict[str, list[Span]]:
    """The spans of each kind, by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    past = dict.fromkeys((*KINDS, "key"), 0)
    for last, (kind, size) in _anchors.iter(_lower(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= past["ip"]:
                found, past["ip"] = ip_at(text, at)
                if found:
                    out["ip"].append(found)
            if at >= past["card"]:
                found, past["card"] = card_at(text, at)
                if found:
                    out["card"].append(found)
            continue
        if at < past[kind]:
            continue
        if kind == "email":
            found = email_at(text, at, past["email"])
        elif kind == "phone":
            found, past["phone"] = phone_at(text, at)
        elif kind == "url":
            found = url_at(text, at, last + 1)
        elif kind == "account":
            found = account_at(text, last + 1)
        elif kind == "secret":
            found = secret_at(text, last + 1)
        else:
            found, kind = key_at(text, at, last + 1), "secret"
            if found and out["secret"] and out["secret"][-1][1] > found[0]:
                found = None
        if found:
            out[kind].append(found)
            past[kind] = max(past[kind], found[1])
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the union has the first kind."""
    if not text:
        return text
    found = sorted((a, b, i) for i, kind in enumerate(KINDS) for a, b in spans(text)[kind]) if _any(text) else []
    if not found:
        return text
    out, at = [], 0
    start, end, kind = found[0]
    for a, b, i in [*found[1:], (len(text) + 1, 0, 0)]:
        if a < end:
            end = max(end, b)
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, start, end, kind = end, a, b, i
    return "".join(out) + text[at:]


def _any(text: str) -> bool:
    return next(_anchors.iter(_lower(text)), None) is not None


def listed(found: dict[str, list[Span]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find(df: DataFrame) -> DataFrame:
    """doc_id, spans array<kind, start, end> of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in b.column(1).to_pylist():
            found = spans(text)
            rows.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_text(narrow(df, "doc_id", "text"), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(df: DataFrame) -> DataFrame:
    """All columns of ``df``, with ``text`` without personal data."""
    i = df.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.set_column(i, b.schema.names[i], pa.array([redact(t) for t in b.column(i).to_pylist()], pa.string()))

    return map_text(df, run, df.schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, all_spans = {k: [] for k in BASE}, [], []
        for text in b.column(1).to_pylist():
            found = spans(text)
            for k in BASE:
                counts[k].append(len(found[k]))
            sha.append(hashlib.sha256(listed(found, BASE).encode()).hexdigest())
            all_spans.append(listed(found))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(sha), pa.array(all_spans)], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return map_text(narrow(df, "doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
