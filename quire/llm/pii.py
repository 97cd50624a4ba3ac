"""Personal data by anchors: one Aho-Corasick pass finds cues, local parsers expand and validate what stands around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_text

#: Order of kinds in a span list: the base ones, then those the method adds.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "url_user")
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
_LABEL = frozenset(LETTERS + DIGITS + "-")
_DIGIT = frozenset(DIGITS)
_PHONE = frozenset(DIGITS + " ().-")
_IDENT = frozenset(LETTERS + DIGITS + "-")
_VALUE = frozenset(LETTERS + DIGITS + "_+/=.~-")
#: Identifier cues and the least digits and most characters of what follows them.
ACCOUNT_CUES = {"iban": (10, 42), "account": (6, 24), "acct": (6, 24), "ssn": (9, 11), "passport": (6, 12)}
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("://", ("scheme", 3))
    for x in DIGITS:
        a.add_word("+" + x, ("phone", 2))
        for y in DIGITS:
            a.add_word(f"{x}.{y}", ("ip", 3))
            a.add_word(f"{x}{y}", ("card", 2))
            a.add_word(f"{x} {y}", ("card", 3))
            a.add_word(f"{x}-{y}", ("card", 3))
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _iban(value: str) -> bool:
    """Country, check digits and 11 to 30 more signs whose number, country and check digits put last and letters as 10 to 35, leaves 1 modulo 97."""
    v = value.replace(" ", "").replace("-", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ssn(value: str) -> bool:
    """Three, two and four digits, none of them all zero, the first neither 666 nor 900 and above."""
    m = re.fullmatch(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})", value)
    return bool(m) and m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000"


#: Further tests of what stands after a cue.
VALID = {"iban": _iban, "ssn": _ssn}


def _run(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _run_back(text: str, at: int, chars: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From an at-sign: the local part back to the last match's end, then labels joined by dots."""
    start = _run_back(text, at, _LOCAL, floor)
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = to, dots + 1
    return (start, end, True) if dots else None


def _ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From a dot between digits: four digit runs, the first of which reaches back as far as it can."""
    start = end = _run_back(text, at + 1, _DIGIT, floor)
    parts = []
    while len(parts) < 4:
        to = _run(text, end, _DIGIT)
        if to == end:
            return None
        parts.append(text[end:to])
        end = to
        if len(parts) < 4:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
    return start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From two digits, at most one blank or hyphen between: the whole chain of such digits."""
    end = at + 1
    n = len(text)
    while end < n:
        if text[end] in _DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 13 <= len(digits) <= 19 and _luhn(digits)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """From a plus and a digit: the longest run of phone signs that ends in a digit."""
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 9 <= sum(c in _DIGIT for c in text[at:end]) <= 15


def _account(text: str, at: int, cue: str) -> tuple[int, int, bool] | None:
    """After an identifier cue and filling (number, no, :, #): letters, digits, hyphens, and single blanks between groups with digits, of a length
    that the cue allows; an IBAN's check digits and a social security number's parts must be right."""
    least, most = ACCOUNT_CUES[cue.lower()]
    if at > len(cue) and text[at - len(cue) - 1].isalnum():
        return None
    m = _FILL.match(text, at)
    start = m.end()
    end = start
    while (to := _run(text, end, _IDENT)) > end and any(c in _DIGIT for c in text[end:to]):
        end = to
        if end < len(text) and text[end] == " " and end - start < most:
            end += 1
        else:
            break
    while end > start and text[end - 1] in " -":
        end -= 1
    good = least <= sum(c in _DIGIT for c in text[start:end]) and end - start <= most
    return (start, end, True) if good and VALID.get(cue.lower(), bool)(text[start:end]) else None


_FILL = re.compile(r"(?:[ \t]*(?:number|num|no\.?|nr\.?|code))?[ \t]*[:=#]?[ \t]*", re.IGNORECASE)
_ASSIGN = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")


def _secret(text: str, at: int) -> tuple[int, int, bool] | None:
    """After a secret's cue and a colon or equals sign: a value of 8 signs or more that has a digit."""
    m = _ASSIGN.match(text, at)
    if not m:
        return None
    start = m.end()
    end = _run(text, start, _VALUE)
    return (start, end, True) if end - start >= 8 and any(c in _DIGIT for c in text[start:end]) else None


def _url_user(text: str, at: int) -> tuple[int, int, bool] | None:
    """After a scheme: user and password up to the host's at-sign."""
    end = at
    while end < len(text) and text[end] not in "/?# \t\r\n\"'<>@":
        end += 1
    return (at, end, True) if end < len(text) and text[end] == "@" and ":" in text[at:end] else None


class Finder:
    def __init__(self) -> None:
        self.anchors = _automaton()
        self.base = {"email": (_email, 0), "ip": (_ip, 2), "card": (_card, 1), "phone": (_phone, 1)}

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Spans (start, end exclusive, in code points) of each kind, in order, without overlap within a kind.

        A base kind's matches are those of its regular expression read from the left: a parser never reaches back behind
        the last match, and an anchor inside a match (also one that failed validation) is passed over.
        """
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        floor = dict.fromkeys(KINDS, 0)
        for last, (kind, n) in self.anchors.iter(text):
            at = last - n + 1
            if kind in self.base:
                parse, _ = self.base[kind]
                if at < floor[kind]:
                    continue
                hit = parse(text, at, floor[kind])
            elif kind == "scheme":
                kind, hit = "url_user", _url_user(text, last + 1)
            elif kind == "account":
                hit = _account(text, last + 1, text[at : last + 1])
            else:
                hit = _secret(text, last + 1)
            if hit and hit[0] >= floor[kind]:
                floor[kind] = hit[1]
                if hit[2]:
                    out[kind].append(hit[:2])
        return out


def _join(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null or empty text has no spans. Null ids and repeated rows are carried as they are. An empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [finder.find(t) for t in as_text(batch.column(1))]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS[:4]]
            sha = pa.array([hashlib.sha256(_join(f, KINDS[:4]).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_join(f, KINDS) for f in found], pa.string())], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each span, overlapping ones merged, replaced by the upper-cased kind of its first part in brackets."""
    flat = sorted((s, -e, KINDS.index(k)) for k, v in spans.items() for s, e in v)
    out, at = [], 0
    for s, minus_e, k in flat:
        e = -minus_e
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, whatever they are named, with personal data in the text masked. Null and empty texts stay as they are; each row is masked by
    its own text, repeated rows alike; an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = [None if t is None else masked(t, finder.find(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
