"""Personal data: base patterns, and disguised ones found on a normalised text with a map back to the source.

A transducer copies the text and rewrites homoglyphs (look-alike letters and digits), spelled digits ("five five",
"nine dot one"), and at/dot disguises ("name [at] host dot org", each separator a sign, in brackets or a word), keeping for every output character the source span
that it stands for. The base patterns then run on the output, and what they find is mapped back to source characters.
Spans of the plain text always stay; a span of the normalised text is added if it overlaps none of the same kind, or is
larger than those it overlaps and holds them.

Positions are code points, ends are exclusive. Defined cases: null counts as empty (no spans); repeated rows are handled
one by one; columns besides text are kept as they are by `stage` and not read.

Each pattern is matched in time linear in the text; none limits the length of an address or a number, or the blanks, tabs
and line breaks around a separator. The last label after "dot" may be any of letters ("look at this dot there" is taken for
an address, too); after another word for it ("at this point in") only a label that ends addresses and isn't a word.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.cluster import ship

KINDS = ("email", "ip", "card", "phone")

# Characters of local parts; patterns of the four kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        part = text[low:at]
        start = low + len(part.rstrip(_LOCAL))
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost without overlap for each kind, by start, then kind as listed."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# Look-alikes of Latin letters, digits and signs (Cyrillic, Greek, small and full-width forms).
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@", " ": " ",
}
_ALIKE |= {chr(0xFF00 + k): chr(0x20 + k) for k in range(1, 95)}
#: Characters that show nothing; the transducer drops them.
_UNSEEN = {"​", "‌", "‍", "⁠", "﻿", "­"}
# Spelled digits in English, German, French and Spanish.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NAMES = "|".join(sorted(_DIGITS, key=len, reverse=True))
_AT, _DOT = r"at|arroba|ät", r"dot|punkt|point|punto"
#: At and dot in brackets.
_BRACKET = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*+[\])}}>]\s*+", re.I)
#: Words and parts of addresses with an at or a dot in words, or an at sign, between them.
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:@|\s++(?:{_AT}|{_DOT})\s++)[A-Za-z0-9._%+-]++)++", re.I)
_SEPARATOR = re.compile(rf"(?P<at>@|\s+(?:{_AT})\s+)|(?P<dot>\s+(?:{_DOT})\s+)", re.I)
# Last labels that are preferred as the end of "x at y dot z", and those among them that are words as well.
_LAST = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|us|eu|de|fr|es|it|nl|at|ch|be|pl|se|no|dk|fi|pt|ru|jp|cn|in|br|mx|ca|au|example|test|invalid|local|dev|app|ai|me|xyz|online|site|mail|cz|sk|hu|ro|bg|gr|tr|ua|kr|tw|hk|sg|nz|za|ar|cl|ie|lt|lv|ee|si|hr|rs|lu"
_KNOWN = frozenset(_LAST.split("|"))
_ALSO_WORDS = frozenset("us|es|it|at|be|se|no|in|ca|au|me|online|site|mail|local|test|example|si|hr".split("|"))
_LABEL, _HOST_LABEL = re.compile(r"[A-Za-z]{2,}"), re.compile(r"[A-Za-z0-9-]+")
#: A word for the sign before a host that is written as usual.
_AT_WORD = re.compile(rf"\s(?:{_AT})\s++[A-Za-z0-9-]++\.[A-Za-z]", re.I)
_GAP = r"[ \t\r\n,()-]*+"
#: At least four numbers in words or figures with blanks, hyphens, brackets or spelled signs between them.
_SPELLED = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9])(?:(?:plus|\+){_GAP})?(?:(?:(?:{_NAMES})(?![A-Za-zÀ-ÿ])|[0-9]++){_GAP}(?:(?:{_DOT}|dash|hyphen|minus)(?![A-Za-zÀ-ÿ]){_GAP})?){{4,}}+", re.I)
_PART = re.compile(rf"(?P<name>{_NAMES})|(?P<fig>[0-9]+)|(?P<plus>plus|\+)|(?P<dot>{_DOT})|(?P<dash>dash|hyphen|minus)|(?P<gap>[ \t\r\n,()-]+)", re.I)
_TRIGGER = re.compile(rf"[{''.join(map(re.escape, [*_ALIKE, *_UNSEEN]))}]")
_HINT = re.compile(r"[\[({<]\s*+(?:[@.]|[AaÄäDdPp])")
_LETTERS = re.compile(r"[^\W\d_]+")
_HINT_WORDS = frozenset([*_DIGITS, *_DOT.split("|"), "plus"])
_PLUS = re.compile(r"(?<![A-Za-zÀ-ÿ])plus\s++(?=[0-9(])", re.I)
#: Letters that stand for figures, among figures only.
_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[ .-]?[0-9OolI]){8,}+")
_MIX = re.compile(r"[0-9][ .-]?[OolI]|[OolI][ .-]?[0-9]")
_FIGURES = {"O": "0", "o": "0", "l": "1", "I": "1"}


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text, self.start, self.end = text, start or list(range(len(text))), end or list(range(1, len(text) + 1))

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Each (start, end, put) in order, without overlaps; every character put stands for the whole span."""
        if not edits:
            return self
        text, start, end, last = [], [], [], 0
        for a, b, put in edits:
            text += [self.text[last:a], put]
            start += self.start[last:a] + [self.start[a]] * len(put)
            end += self.end[last:a] + [self.end[b - 1]] * len(put)
            last = b
        return Mapped("".join([*text, self.text[last:]]), start + self.start[last:], end + self.end[last:])


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a spelled number into figures; blanks between figures are kept short, spelled signs become signs."""
    body = m[0].rstrip(" \t\r\n,()-")
    parts = list(_PART.finditer(m.string, m.start(), m.start() + len(body)))
    kinds = [p.lastgroup for p in parts]
    if sum(k in ("name", "fig") for k in kinds) < 4 or not ("name" in kinds or "dot" in kinds):
        return []
    edits = []
    for k, p in enumerate(parts):
        if p.lastgroup == "gap" and "name" not in kinds and "dot" not in kinds[max(0, k - 1) : k + 2]:
            continue  # figures stay apart, but for those around a spelled dot
        put = {"name": _DIGITS.get(p[0].lower(), ""), "fig": p[0], "plus": "+", "dot": ".", "dash": "-", "gap": ""}[p.lastgroup]
        if put != p[0]:
            edits.append((p.start(), p.end(), put))
    return edits


def _addresses(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn the separators in words of a chain's addresses into signs.

    For each at, the local part is what dots join to its left, the host what dots join to its right.
    """
    parts, at = [], m.start()  # (at or dot before it or None, its span, part's start, part's end)
    for sep in [*_SEPARATOR.finditer(m.string, m.start(), m.end()), None]:
        parts.append((at, sep.start() if sep else m.end(), sep))
        at = sep.end() if sep else at
    edits = {}
    for k in (k for k, (_, _, sep) in enumerate(parts) if sep and sep["at"]):
        found = _host(m.string, parts, k)
        if found is not None:
            j = k
            while j and parts[j - 1][2]["dot"]:
                j -= 1
                edits[parts[j][2].span()] = "."
            if parts[k][2][0] != "@":
                edits[parts[k][2].span()] = "@"
            edits.update((span, ".") for span in found)
    return [(a, b, put) for (a, b), put in sorted(edits.items())]


def _host(text: str, parts, k: int) -> list[tuple[int, int]] | None:
    """Spans of the dots in words inside the host after the k-th part's at, or None if no host follows."""
    labels, dots, explicit, words = [], [], [], []  # for each label what is true up to it
    sign, spoken, spans = parts[k][2][0] == "@", False, []
    for start, end, sep in parts[k + 1 :]:
        for n, label in enumerate(text[start:end].split(".")):
            if not _HOST_LABEL.fullmatch(label):
                sep = None
                break
            sign |= n > 0
            labels.append(label)
            dots.append(len(spans))
            explicit.append(sign)
            words.append(spoken)
        if not sep or sep["at"]:
            break
        spans.append(sep.span())
        spoken |= sep[0].strip().lower() != "dot"
    usable = [k for k in range(1, len(labels))]
    # A known label, or any after a sign, ends the host; else any label, if "dot" is the only word between labels, as
    # "at this point in" is no address.
    for k in reversed(usable):
        known = labels[k].lower() in _KNOWN and not (words[k] and not explicit[k] and labels[k].lower() in _ALSO_WORDS)
        if known or (explicit[k] and _LABEL.fullmatch(labels[k])):
            return spans[: dots[k]]
    for k in reversed(usable):
        if not words[k] and _LABEL.fullmatch(labels[k]):
            return spans[: dots[k]]
    return None


def _mixed(m: re.Match) -> list[tuple[int, int, str]]:
    found = m[0]
    if m.string[m.end() : m.end() + 1].isalnum():  # the last part belongs to a word
        found = found[: max(found.rfind(c) for c in " .-") + 1]
    if len(_DIGIT.findall(found)) < 6 or sum(c not in "+ .-" for c in found) < 9:
        return []
    return [(m.start() + k, m.start() + k + 1, _FIGURES[c]) for k, c in enumerate(found) if c in _FIGURES]


def normalised(text: str) -> Mapped | None:
    """The transducers' output, or None where nothing calls for them."""
    alike = not text.isascii() and _TRIGGER.search(text)
    spoken = not _HINT_WORDS.isdisjoint(_LETTERS.findall(text.lower())) or _HINT.search(text) or _AT_WORD.search(text)
    mixed = _DIGIT.search(text) and _MIX.search(text)
    if not (alike or spoken or mixed):
        return None
    now = Mapped(text)
    if alike:
        now = now.replaced([(m.start(), m.end(), _ALIKE.get(m[0], "")) for m in _TRIGGER.finditer(text)])
    if mixed:
        now = now.replaced([e for m in _MIXED.finditer(now.text) for e in _mixed(m)])
    now = now.replaced([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(now.text)])
    now = now.replaced([e for m in _CHAIN.finditer(now.text) for e in _addresses(m)])
    now = now.replaced([e for m in _SPELLED.finditer(now.text) for e in _spelled(m)])
    return now.replaced([(m.start(), m.end(), "+") for m in _PLUS.finditer(now.text)])


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and the base spans with those of the normalised text."""
    base = base_spans(text)
    now = normalised(text)
    if now is None or now.text == text:
        return base, base
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    more = []
    for kind, a, b in base_spans(now.text):
        start, end = now.start[a], now.end[b - 1]
        if not any(start < y and x < end and not (start <= x and y <= end and end - start > y - x) for x, y in taken[kind]):
            more.append((kind, start, end))
            taken[kind].append((start, end))
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by <KIND> of its first span."""
    out, last, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[last:a], f"<{kind.upper()}>"]
        last, k = b, k + 1
    return "".join([*out, text[last:]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans of each row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, digest, found = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "")
                for n, kind in zip(counts, KINDS):
                    n.append(sum(k == kind for k, _, _ in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digest, pa.string()), pa.array(found, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def stage(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind; n_chars, where there, counts the new text."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            texts = [t and masked(t, all_spans(t)[1]) for t in columns["text"].to_pylist()]
            changed = [t is not None and t != s for t, s in zip(texts, columns["text"].to_pylist())]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, columns["n_chars"].to_pylist())], kind)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)
