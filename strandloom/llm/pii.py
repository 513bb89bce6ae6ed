"""Personal data, plain and disguised, with spans in the source text.

Transducers rewrite a text and keep, for each character they write, the source
characters it stands for: homoglyphs and foreign digits become ASCII, spelled digits
become digits (runs of them are joined), and at/dot disguises become `@` and `.`.
The detectors run on the source and on the rewritten text; what only the second shows
is mapped back to source characters and added to the first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match of the plain pattern can begin only where a run of digits does; so this has the same matches in linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_IP_RUN = re.compile(r"[0-9][0-9.]{6,}")  # a match is inside such a run
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By the `@`, of which a match has just one: the run before it, not before the last match's end, and the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def detect(text: str) -> list[Span]:
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for run in _IP_RUN.finditer(text):
        for m in _IP.finditer(text, *run.span()):
            if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _homoglyphs() -> dict[int, str]:
    """Characters that look like one ASCII character: by Unicode's own compatibility and digit data, and listed letters."""
    table = {}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA)]:
        s = unicodedata.normalize("NFKC", chr(c))
        if len(s) == 1 and s.isascii():
            table[c] = s
    for c in range(0x80, 0x11000):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
    # Cyrillic, then Greek and phonetic letters, with the Latin letters that they look like; then dots, at signs, dashes and spaces.
    table |= dict(zip(map(ord, "АВЕЅІЈКМНОРСТХаеорсухіјѕһӏԁԛԝ"), "ABESIJKMHOPCTXaeopcyxijshldqw"))
    table |= dict(zip(map(ord, "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυɑɡ"), "ABEZHIKMNOPTYXaivopuag"))
    table |= dict(zip(map(ord, "\u2024\u3002\uff61\ufe52\ufe6b\u2010\u2011\u2012\u2013\u2014\u00a0\u2007\u2009\u202f"), "....@-----    "))
    return table


HOMOGLYPHS = _homoglyphs()
_FOREIGN = re.compile("[\u00a0\u0250-\U0010ffff]")  # of the characters mapped, none is outside
#: Spelled digits of the languages of the corpus: English, German, French, Spanish.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_D = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<![^\W_]){_D}(?:(?:[ \-]{{1,3}}|,\s{{0,2}}|\.|\sdot\s){_D})*(?![^\W_])")
_ONE = re.compile(rf"(?i){_D}")
_AT = r"\s{0,3}(?:\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<\s?at\s?>|@)\s{0,3}"
_DOT = r"\s?(?:\[\s?(?:dot|\.)\s?\]|\(\s?(?:dot|\.)\s?\)|\{\s?dot\s?\}|<\s?dot\s?>)\s?|\sdot\s"
_NAME, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
#: A marked `at` takes any dots; the bare word counts only together with a disguised dot: name at host dot top.
_MAILS = (re.compile(rf"(?i){_NAME}(?P<at>{_AT}){_HOST}(?:(?:{_DOT}|\.){_HOST})+"), re.compile(rf"(?i){_NAME}(?P<at>\sat\s){_HOST}(?:\.{_HOST})*(?:{_DOT})(?:{_HOST})(?:(?:{_DOT}|\.){_HOST})*"))
_DOTS = re.compile(rf"(?i){_DOT}")
_AT_CORES = (re.compile(r"(?i)[\[({<]\s?at\s?[\])}>]|@"), re.compile(r"(?i)\sat\s"))
_NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])(?:{_DOT})(?=[0-9])")
_DOT_END = re.compile(rf"(?i)(?:{_DOT})\Z")
_PLUS = re.compile(r"(?i)(?<![^\W_])plus\s(?=[0-9])")
#: What a text with a disguise has; others are not searched.
_AT_SIGNS = ("at]", "at )", "at)", "at ]", "at}", "at }", "at>", "at >", " @", "@ ", "@\n", "\n@")
_DOT_SIGNS = (" dot ", "\ndot ", " dot\n", "\ndot\n", "dot]", "dot)", "dot}", "dot>", "[dot", "(dot", "{dot", "<dot", "[.", "(.", "[ .", "( .")
_DIGIT_WORDS = frozenset(w.encode() for w in DIGITS)
_NOT_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


class Rewritten:
    """A text with the source span of each character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, parts: list[tuple[int, int, str]]) -> None:
        """Put s in place of text[a:b]; each character written stands for all of the part."""
        if not parts:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, s in parts:
            text += [self.text[at:a], s]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(s)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(s)]
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Each spelled digit of a run as a digit, with the separator before it (a spelled dot stays one)."""
    out, last = [], m.start()
    for w in _ONE.finditer(m.string, m.start(), m.end()):
        between = m.string[last : w.start()].lower()
        dot = "." if "dot" in between or "." in between else ""
        out.append((last, w.end(), dot + DIGITS[w[0].lower()]))
        last = w.end()
    return out


def rewrite(text: str) -> Rewritten | None:
    """None if there is nothing to rewrite."""
    plain = text.translate(HOMOGLYPHS) if not text.isascii() and _FOREIGN.search(text) else text
    low = plain.lower()
    spelled = not _DIGIT_WORDS.isdisjoint(low.encode("utf-8", "surrogatepass").translate(_NOT_LETTERS).split())
    dots = any(x in low for x in _DOT_SIGNS)
    mails = dots and ("@" in low or "at" in low) or any(x in low for x in _AT_SIGNS)
    if not (spelled or dots or mails or "plus" in low or plain != text):
        return None
    r = Rewritten(plain)
    if spelled:
        r.replace([p for m in _SPELLED.finditer(r.text) if len(_ONE.findall(m[0])) > 1 or _near_number(r.text, m) for p in _spelled(m)])
    if dots:
        r.replace([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    r.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(r.text)] if "plus" in low else [])
    for pattern, core in zip(_MAILS, _AT_CORES) if mails else ():
        mail: list[tuple[int, int, str]] = []
        last = 0
        for at in core.finditer(r.text):
            start = at.start()
            while start > max(last, at.start() - 3) and r.text[start - 1].isspace():
                start -= 1
            while start > last and r.text[start - 1] in _LOCAL:
                start -= 1
            if m := pattern.match(r.text, start):
                mail.append((*m.span("at"), "@"))
                mail += [(d.start(), d.end(), ".") for d in _DOTS.finditer(r.text, m.end("at"), m.end())]
                last = m.end()
        r.replace(mail)
    if dots and "@" in r.text:
        r.replace(_name_dots(r.text))
    return r if r.text != text else None


def _name_dots(text: str) -> list[tuple[int, int, str]]:
    """Disguised dots between the parts of the name before each `@`, from right to left."""
    out: list[tuple[int, int, str]] = []
    last = 0
    for at in re.finditer("@", text):
        start, found = at.start(), []
        while True:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            low = max(last, start - 12)
            dot = _DOT_END.search(text[low:start])
            if start == at.start() or not dot or low + dot.start() <= last or text[low + dot.start() - 1] not in _LOCAL:
                break
            found.append((low + dot.start(), start, "."))
            start = low + dot.start()
        out += reversed(found)
        last = at.end()
    return out


def _near_number(text: str, m: re.Match) -> bool:
    """A single spelled digit counts only between digits, one separator away."""
    a, b = m.span()
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    return before[-1:] in " -." and before[:1].isdigit() or after[:1] in " -." and after[1:].isdigit()


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that only the rewritten text shows, in source characters)."""
    base = detect(text)
    if (r := rewrite(text)) is None:
        return base, []
    # base spans of a kind don't overlap, and rewriting keeps their order: one pass finds what holds a span
    held = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    at, last = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, (0, 0))
    added = []
    for kind, a, b in detect(r.text):
        a, b = r.starts[a], r.ends[b - 1]
        own = held[kind]
        while at[kind] < len(own) and own[at[kind]][0] <= a:
            at[kind] += 1
        x, y = own[at[kind] - 1] if at[kind] else (0, 0)
        if b > y and not (last[kind][0] <= a and b <= last[kind][1]):
            added.append((kind, a, b))
            last[kind] = (a, b)
    return base, added


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row for each row of docs.

    Counts and base_sha256 are of the base spans; `spans` has the added ones too. An
    added span is never inside another of its kind; it may hold a base span that a
    disguise cut short. Null text counts as empty; repeated
    rows stay; an empty table gives an empty one; other columns are not read.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                base, added = find(text)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), digest(joined(base, KINDS)), joined([*base, *added], KINDS), len(added)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").values)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(run, schema)
