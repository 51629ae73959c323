"""Personal data in texts, plain and disguised, with places in the text as it was given."""

from __future__ import annotations

import re
import string
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrays import slices

KINDS = ("email", "ip", "card", "phone")

# Plain identifiers.  The patterns are the base rules in a form whose time is linear in the
# text: matches begin only where the leftmost one can, and runs are not given back.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((begin, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip_ok(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _card_ok(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(match: str) -> bool:
    return 9 <= len(_DIGIT.findall(match)) <= 15


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules; end exclusive, in code points."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, good in (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if good(m[0])]
    return spans


# Letters of other scripts that look like Latin ones, in the order of the Latin letters.
_LOOKALIKES = str.maketrans(
    "аеоорсхуіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅαοορντικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeoopcxyijsdhkmtbhABEKMHOPCTXYIJSaoopvtikeABEZHIKMNOPTYX",
)
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(_DIGIT_WORDS) + ")"
_GAP = r"(?:[ ,]|-|\s)\s?"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_MARK = re.compile(rf"[ ]?{_OPEN}[ ]?(at|dot|@|\.)[ ]?{_CLOSE}[ ]?|&#(64|46);", re.I | re.A)
_BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]+(?:\s{1,3}dot\s{1,3}[A-Za-z0-9._%+-]+){0,4})(?P<at>\s{1,3}at\s{1,3})"
    r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?P<dots>(?:\s{1,3}dot\s{1,3}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)+)(?![A-Za-z0-9-])",
    re.I | re.A,
)
_BARE_DOT = re.compile(r"\s{1,3}dot\s{1,3}", re.I | re.A)
_SPELLED = re.compile(rf"\b(?:plus{_GAP})?(?:{_WORD}|[0-9])(?:{_GAP}(?:{_WORD}|dot|point|[0-9]))" r"{6,}\b", re.I | re.A)
_MIXED = re.compile(rf"\b(?:plus{_GAP})?(?:{_WORD}|[0-9]{{1,19}})(?:{_GAP}(?:{_WORD}|dot|point|[0-9]{{1,19}}))" r"{2,}\b", re.I | re.A)
_SPELLED_PART = re.compile(rf"plus|{_WORD}|dot|point|[0-9]+", re.I | re.A)
_SPELLED_HINT = re.compile(rf"\b{_WORD}{_GAP}{_WORD}\b", re.I | re.A)


@lru_cache(maxsize=1 << 16)
def _folded(char: str) -> str:
    """The ASCII character that a lookalike stands for, nothing for an invisible one, else the same."""
    if char in _INVISIBLE:
        return ""
    plain = char.translate(_LOOKALIKES)
    if plain == char and not char.isascii():
        plain = unicodedata.normalize("NFKC", char)
        if char in "․。｡":
            plain = "."
        elif (digit := unicodedata.decimal(char, None)) is not None:
            plain = str(digit)
    return plain if len(plain) == 1 and plain.isascii() else char


class Mapped:
    """A rewritten text; each character knows the source characters it came from."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def rewrite(self, changes: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> None:
        """Replace [start, end) by a text; its characters come from the given ranges (default: all of it)."""
        text, starts, ends, done = [], [], [], 0
        for a, z, new, ranges in changes:
            ranges = ranges or [(a, z)] * len(new)
            text += [self.text[done:a], new]
            starts += [self.starts[done:a], np.array([self.starts[s] for s, _ in ranges], np.int64)]
            ends += [self.ends[done:a], np.array([self.ends[e - 1] for _, e in ranges], np.int64)]
            done = z
        self.text = "".join([*text, self.text[done:]])
        self.starts = np.concatenate([*starts, self.starts[done:]])
        self.ends = np.concatenate([*ends, self.ends[done:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def fold_characters(m: Mapped) -> bool:
    """Lookalike letters, full-width and styled forms become ASCII; invisible characters go."""
    changed = {c: f for c in set(m.text) if not c.isascii() and (f := _folded(c)) != c}
    if not changed:
        return False
    if "" in changed.values():
        gone = "[" + "".join(re.escape(c) for c, f in changed.items() if not f) + "]+"
        m.rewrite([(*x.span(), "", None) for x in re.finditer(gone, m.text)])
    m.text = m.text.translate(str.maketrans(changed))
    return True


def join_marks(m: Mapped) -> bool:
    """Bracketed or coded at and dot signs, and ``name at host dot tld``, become signs."""
    found = [(*x.span(), "@" if (x[1] or x[2]).lower() in ("at", "@", "64") else ".", None) for x in _MARK.finditer(m.text)]
    if found:
        m.rewrite(found)
    bare = []
    for x in _BARE.finditer(m.text):
        bare += [(*d.span(), ".", None) for d in _BARE_DOT.finditer(m.text, *x.span("local"))]
        bare.append((*x.span("at"), "@", None))
        bare += [(*d.span(), ".", None) for d in _BARE_DOT.finditer(m.text, *x.span("dots"))]
    if bare:
        m.rewrite(bare)
    return bool(found or bare)


def join_spelled_digits(m: Mapped, pattern: re.Pattern = _SPELLED) -> bool:
    """Runs with at least seven digits, spelled or (by ``_MIXED``) also in groups, become digits."""
    if not _SPELLED_HINT.search(m.text):
        return False
    changes = []
    for x in pattern.finditer(m.text):
        parts = list(_SPELLED_PART.finditer(m.text, *x.span()))
        sign = {"plus": "+", "dot": ".", "point": "."} | _DIGIT_WORDS
        new = [sign.get(p[0].lower(), p[0]) for p in parts]
        if pattern is _SPELLED or (len("".join(new)) >= 7 and any(p[0].lower() in _DIGIT_WORDS for p in parts)):
            places = [(p.start() + i, p.start() + i + 1) if p[0].isdigit() else p.span() for p, c in zip(parts, new) for i in range(len(c))]
            changes.append((*x.span(), "".join(new), places))
    if changes:
        m.rewrite(changes)
    return bool(changes)


def find_disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans of identifiers that show only after the disguises are undone, in source characters.

    Spelled digits are joined twice, alone and with groups of digits beside them.
    """
    found = set()
    for pattern in (_SPELLED, _MIXED):
        m = Mapped(text)
        changed = [fold_characters(m), join_marks(m)]
        spelled = join_spelled_digits(m, pattern)
        if spelled or (pattern is _SPELLED and any(changed)):
            found |= {(kind, *m.source(a, z)) for kind, a, z in find_plain(m.text)}
        if not _SPELLED_HINT.search(m.text) and not spelled:
            break
    return sorted(s for s in found if not any(o != s and o[0] == s[0] and o[1] <= s[1] and s[2] <= o[2] for o in found))


def find_identifiers(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added), by kind, start and end.

    Spans of the base rules stay; a disguised identifier is added unless it lies within one
    of its kind.
    """
    plain = find_plain(text)
    spans = [(*s, False) for s in plain]
    for kind, a, z in find_disguised(text):
        if not any(k == kind and s <= a and z <= e for k, s, e in plain):
            spans.append((kind, a, z, True))
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), *s[1:]))


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans`` (kind, start, end exclusive, added).

    Places are code points of the text as given; null and empty texts have no spans.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            spans = [
                [dict(zip(("kind", "start", "end", "added"), s)) for s in find_identifiers(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _ARROW_SPANS)], names=["id", "spans"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
