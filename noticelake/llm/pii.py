"""Personal data by offset-preserving deobfuscation.

Two readings of every whole text. The plain reading finds e-mail addresses, IPv4 addresses, payment
card numbers and phone numbers by fixed patterns. The second reading passes the text through
transducers, each of which rewrites one disguise (homoglyphs and invisible characters, at/dot
disguises, spelled digits, letters that stand for digits) while carrying the source position of every
character; the same patterns are then applied and the spans mapped back to the source. A span of the
second reading is added where it overlaps no plain span of its kind. Texts without any trace of a
disguise are read once.

Spans are code point offsets, end exclusive.

Defined cases: a null text is empty and has no spans; patterns need time linear in the text, so very
long texts and runs are safe; equal rows get equal results; other columns are carried, a column named
`spans` is replaced.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<kind string, start long, end long, plain boolean>>"

#: Fixed patterns. Runs are possessive, since giving characters back never helps a match.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")  # a run of digits is passed as a whole
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _valid_ip(found: str) -> bool:
    return "." in found and all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in found.split(".")))


def _valid_card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _valid_phone(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every identifier, leftmost and non-overlapping for each kind, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, valid in ((1, _IP, _valid_ip), (2, _CARD, _valid_card), (3, _PHONE, _valid_phone)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(found)


# ---- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like ASCII letters, in order.
_CYRILLIC = dict(zip("абсԁеһіјӏорѕухАВЕІЈКМНОРСТУХЅ", "abcdehijlopsyxABEIJKMHOPCTYXS"))
_GREEK = dict(zip("αικνορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiknopuABEZHIKMNOPTYX"))
_SIGNS = dict.fromkeys("\u00b7\u2022\u2219\u22c5\u3002", ".") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-") | {"\u00a0": " "}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _look_alikes() -> dict[str, str]:
    """Every character outside ASCII whose compatibility form is one ASCII character or whose digit value is known, with the tables above."""
    table = {}
    for first, last in ((0x80, 0x3100), (0xA620, 0xABFA), (0xFE50, 0xFFF0), (0x1D400, 0x1D800), (0x1FBF0, 0x1FBFA)):
        for code in range(first, last):
            c = chr(code)
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and 32 < ord(form) < 127:
                table[c] = form
            elif (digit := unicodedata.digit(c, None)) is not None:
                table[c] = str(digit)
    return table | _CYRILLIC | _GREEK | _SIGNS | dict.fromkeys(_INVISIBLE, "")


_ALIKE = _look_alikes()
_ALIKE_CHAR = re.compile("[" + "".join(re.escape(c) for c in sorted(_ALIKE) if c < "\U00010000") + "]")
_ALIKE_HIGH = re.compile("[\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9]")

#: Words for the at sign, the dot, and the ten digits.
_AT_WORDS, _DOT_WORDS = "at|arroba|chez|ät", "dot|punto|punkt|point"
_DIGIT_WORDS = [
    "zero oh null zéro cero",
    "one eins un uno",
    "two zwei zwo deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
]
_DIGIT_OF = {word: str(d) for d, words in enumerate(_DIGIT_WORDS) for word in words.split()}
_SPOKEN_SIGN = {"dot": ".", "punto": ".", "punkt": ".", "point": ".", "plus": "+", "más": "+", "dash": "-", "hyphen": "-"}
_SPOKEN = re.compile(
    r"(?<![^\W_])(?:plus\s+|\+\s*)?(?:{d})(?:[\s,-]++(?:{d}|{s}|[0-9]++)){{3,}}(?![^\W_])".format(d="|".join(sorted(_DIGIT_OF, key=len, reverse=True)), s="|".join(_SPOKEN_SIGN)), re.I
)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:[@.]|{_AT_WORDS}|{_DOT_WORDS})\s*[\])}}>]", re.I)
_BRACKET_AT = re.compile(rf"\s*[\[({{<]\s*(?:@|{_AT_WORDS})\s*[\])}}>]\s*", re.I)
_BRACKET_DOT = re.compile(rf"\s*[\[({{<]\s*(?:\.|{_DOT_WORDS})\s*[\])}}>]\s*", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\x20@\x20(?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
#: Blanks around a dot of a host; a plain "at" between a name with a digit, dot or underscore and a host with a usual ending.
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9])\x20\.\x20(?=[A-Za-z0-9])")
_NAMED_AT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9%+-]*[0-9._][A-Za-z0-9._%+-]*)\s+(?:{_AT_WORDS})\s+(?=(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es)(?![A-Za-z0-9]))", re.I
)
_HOST_ENDS = (".com", ".org", ".net", ".edu", ".gov", ".info", ".io", ".eu", ".uk", ".de", ".fr", ".es")
#: Groups of four digits that other signs than blanks and hyphens hold together.
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_PLAIN_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{_DOT_WORDS})\s+|_(?:{_DOT_WORDS})_)(?=[A-Za-z0-9])", re.I)
#: A dot that was a plain word is marked, because a plain word "at" counts only before a host with such a dot.
_MARK = "\ue000"
_MARKED_DOT = re.compile(re.escape("." + _MARK))
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{_AT_WORDS})\s+|_(?:{_AT_WORDS})_)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.{_MARK})", re.I)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl|](?=[\x20-]?[0-9])|(?<=[0-9][\x20-])[OoIl|](?=[0-9])")
_LETTER_AMONG = re.compile(r"[0-9][\x20-]?[OoIl|][\x20-]?[0-9]")


class Aligned:
    """A text together with the source interval of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, form: Callable[[re.Match], str]) -> None:
        """Replace every match; each character of a replacement stands for the whole match."""
        parts, starts, ends, done = [], [], [], 0
        for match in pattern.finditer(self.text):
            a, b = match.span()
            new = form(match)
            if b == a or new == match.group():
                continue
            parts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a])]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        if parts:
            self.text = "".join([*parts, self.text[done:]])
            self.start = np.concatenate([*starts, self.start[done:]])
            self.end = np.concatenate([*ends, self.end[done:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _spoken_digits(match: re.Match) -> str:
    out = []
    for word in re.split(r"[\s,-]+", match.group().lower().replace("+", "plus ")):
        out.append(_DIGIT_OF.get(word) or _SPOKEN_SIGN.get(word) or word)
    return "".join(out)


_DOTS = frozenset(_DOT_WORDS.split("|"))
_DIGITS = frozenset(_DIGIT_OF)
_SEPARATED = str.maketrans(dict.fromkeys(string.punctuation, " "))


def _traces(text: str) -> tuple[bool, bool]:
    """Whether words may stand for dots, and whether four digit words, signs and figures, one a digit word, may follow each other."""
    words = text.lower().translate(_SEPARATED).split()
    distinct = set(words)
    spoken = not distinct.isdisjoint(_DIGITS) and "1111" in "".join(["1" if w in _DIGITS or w in _SPOKEN_SIGN or w.isdecimal() else "0" for w in words])
    return not distinct.isdisjoint(_DOTS), spoken


def deobfuscated(text: str) -> Aligned | None:
    """The text after all transducers, or None where no disguise is possible."""
    alike = not text.isascii() and (_ALIKE_CHAR.search(text) or _ALIKE_HIGH.search(text))
    dots, spoken = _traces(text)
    at_sign = "@" in text and _SPACED_AT.search(text)
    bracketed = ("(" in text or "[" in text or "{" in text or "<" in text) and _BRACKETED.search(text)
    spaced = " @ " in text and _SPACED_DOT.search(text)
    low = text.lower()
    named = any(end in low for end in _HOST_ENDS) and _NAMED_AT.search(text)
    if not (alike or dots or spoken or at_sign or bracketed or spaced or named or _LETTER_AMONG.search(text) or _GROUPED.search(text)):
        return None
    out = Aligned(text)
    if alike:
        out.rewrite(_ALIKE_CHAR, lambda m: _ALIKE[m.group()])
        out.rewrite(_ALIKE_HIGH, lambda m: _ALIKE.get(m.group(), m.group()))
    if spoken or alike:
        out.rewrite(_SPOKEN, _spoken_digits)
    out.rewrite(_BRACKET_AT, lambda m: "@")
    out.rewrite(_BRACKET_DOT, lambda m: ".")
    if dots or alike:
        out.rewrite(_PLAIN_DOT, lambda m: "." + _MARK)
        out.rewrite(_PLAIN_AT, lambda m: "@")
        out.rewrite(_MARKED_DOT, lambda m: ".")
    if spaced:
        out.rewrite(_SPACED_DOT, lambda m: ".")
    if named:
        out.rewrite(_NAMED_AT, lambda m: m[1] + "@")
    out.rewrite(_SPACED_AT, lambda m: "@")
    out.rewrite(_GROUPED, lambda m: m.group().replace(m[1], "-"))
    out.rewrite(_LETTER_DIGIT, lambda m: "0" if m.group() in "Oo" else "1")
    return out if out.text != text else None


def spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind; `plain` tells those of the plain reading."""
    text = text or ""
    plain = identifiers(text)
    found = [(a, kind, b, True) for a, kind, b in plain]
    if (second := deobfuscated(text)) is not None:
        taken = {kind: [(a, b) for a, k, b in plain if k == kind] for kind in range(len(KINDS))}
        for a, kind, b in identifiers(second.text):
            start, end = second.source(a, b)
            if all(end <= x or start >= y for x, y in taken[kind]):
                taken[kind].append((start, end))
                found.append((start, kind, end, False))
    return [{"kind": KINDS[kind], "start": a, "end": b, "plain": p} for a, kind, b, p in sorted(found)]


def spans_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([spans(t) for t in texts])

    return found(text)


def detect(docs: DataFrame) -> DataFrame:
    """docs with spans: array of (kind, start, end, plain)."""
    return docs.drop("spans").withColumn("spans", spans_column(F.col("text")))
