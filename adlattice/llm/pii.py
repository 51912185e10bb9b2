"""Personal data: regular expressions propose spans, checksums and ranges confirm
them, and words nearby adjust each span's score.

The four base kinds are found as plain leftmost non-overlapping matches. Every
pattern is anchored at the start of a run and consumes it at once, so the time is
linear in the text even for one endless word or number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")  # a start, and the most that may follow
_SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|password|passwd)\b\x20?[=:]\x20?[\x22']?([A-Za-z0-9_/+=-]{16,}+)")

#: Characters of an account by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31,
    "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Fixed words that speak for a kind when they stand nearby.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "number"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "secret": ("token", "key", "secret", "password"),
}
#: Scores before context: the more a checksum excludes, the higher.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8}
NEAR = 40  # characters of context on either side
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: the rearranged code, letters as 10 to 35, leaves 1."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def _account(text: str, start: int, most: int, length: int | None) -> int | None:
    """End of the account of this length that starts here and goes to `most` at the
    furthest; without a length, the last end for which mod-97 holds. Ends are at token
    borders."""
    ends, n = [], 0
    for i in range(start, most):
        if text[i] != " ":
            n += 1
            after = text[i + 1 : i + 2]
            if n >= 15 and length in (None, n) and not (after.isascii() and after.isalnum()):
                ends.append(i + 1)
    return next((e for e in reversed(ends) if mod97(text[start:e])), None)


def _ibans(text: str) -> list[tuple[int, int]]:
    """Accounts of countries in the list, by length, and of others in what is left. Where a
    start gives none, the search goes on right after it."""
    starts = [(m.start(), m.end(1)) for m in _IBAN.finditer(text)]  # what follows a start is looked at, not consumed
    found, end = [], 0
    for start, most in starts:
        length = IBAN_LENGTHS.get(text[start : start + 2])
        if length and start >= end and (e := _account(text, start, most, length)):
            found.append((start, e))
            end = e
    listed_, end, k = list(found), 0, 0
    for start, most in starts:
        while k < len(listed_) and listed_[k][0] <= start:
            end, k = max(end, listed_[k][1]), k + 1
        most = min(most, listed_[k][0]) if k < len(listed_) else most
        if start >= end and text[start : start + 2] not in IBAN_LENGTHS and (e := _account(text, start, most, None)):
            found.append((start, e))
            end = e
    return found


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """Kinds of the method's own: bank accounts by mod-97, named secrets."""
    spans = [(s, 4, e) for s, e in _ibans(text)]
    if "=" in text or ":" in text:
        spans += [(m.start(1), 5, m.end(1)) for m in _SECRET.finditer(text)]
    return spans


def score(text: str, start: int, kind: int, end: int) -> float:
    """Prior of the kind, raised by a context word nearby."""
    near = set(_WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    return min(1.0, PRIOR[KINDS[kind]] + (0.2 if near & set(CONTEXT[KINDS[kind]]) else 0.0))


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, score), by start and kind."""
    text = text or ""
    spans = sorted(base_spans(text) + more_spans(text))
    return [(s, k, e, score(text, s, k, e)) for s, k, e in spans]


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with counts, spans and the highest score for every row; null is empty.

    Spans of different kinds may overlap; repeated rows give repeated results; an empty
    table gives none. Whole texts are read, of any length, in time linear in it. Columns
    other than doc_id and text are not read.
    """

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            found = [find(t) for t in part["text"]]
            base = [[s for s in spans if s[1] < len(BASE)] for spans in found]
            yield {
                "doc_id": part["doc_id"],
                **{f"n_{k}": [sum(s[1] == i for s in spans) for spans in base] for i, k in enumerate(BASE)},
                "base_sha256": [sha256(listed(spans).encode()).hexdigest() for spans in base],
                "spans": [listed(spans) for spans in found],
                "top_score": [max((s[3] for s in spans), default=0.0) for spans in found],
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", "text"), run,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double",
    )


def redact(text: str | None) -> str | None:
    """text with each span's characters replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
