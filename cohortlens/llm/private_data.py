"""Personal data, with disguises undone and places kept.

Four kinds of identifiers are detected in the text as it stands.  The text then
passes three transducers, each of which rewrites pieces and keeps for every
character the interval of the source it came from:

1. homoglyphs: compatibility forms, other scripts' digits, look-alike letters
   of words that are spelled with look-alikes, invisible characters;
2. spelled digits: runs of four or more digit words;
3. at / dot disguises: bracketed ones, and the bare words where they spell a
   whole address.

The same detectors run on the normalised text; what they find is mapped back to
the source, and reported if the source spells it otherwise.

Every detector takes time in proportion to the text: patterns start only where
a run starts, so that a long run is read once and not from each of its places.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ship

#: Order in which kinds at one place are listed.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- detectors -------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the head of a run of digits: from any later digit of the
# run the pattern goes on alike, and a match before ends at the end of a run.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Around every @: what may stand before it, back to the last match or @,
    and the domain."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[free:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if run else None
        if found:
            out.append((at - run, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text)
            if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split("."))
            and all(int(p[-3:]) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        found = _digits(m[0])
        if 12 <= len(found) <= 19 and luhn(found):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[Span]]:
    return {kind: DETECTORS[kind](text) for kind in KINDS}


# ---- transducers -----------------------------------------------------------------

class Mapped:
    """A text whose characters know their interval in the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = self.stop = None      # until the first edit every character is its own

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the pieces [i, j), given in order without overlap; all
        characters of a replacement come from the whole piece."""
        if not edits:
            return
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.stop = self.start + 1
        text, start, stop, at = [], [], [], 0
        for i, j, new in edits:
            text += [self.text[at:i], new]
            start += [self.start[at:i], np.full(len(new), self.start[i])]
            stop += [self.stop[at:i], np.full(len(new), self.stop[j - 1])]
            at = j
        self.text = "".join(text) + self.text[at:]
        self.start = np.concatenate([*start, self.start[at:]])
        self.stop = np.concatenate([*stop, self.stop[at:]])

    def back(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.stop[span[1] - 1])


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХаеіјосрѕух" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρ" "ıԁԛԝ",
    "ABESIJKMHOPCTXaeijocpsyx" "ABEZHIKMNOPTYXoivp" "idqw"))
#: Punctuation that looks like the ASCII one.
_POINTS = {"。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
           "−": "-", " ": " "}
_INVISIBLE = "­​‌‍⁠﻿"


def _ascii_form(c: str) -> str | None:
    """The ASCII character that a letter, digit or sign stands for, if any."""
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    flat = unicodedata.normalize("NFKC", c)
    return flat if kind[0] in "LPSZ" and kind not in ("Lo", "Lm") and len(flat) == 1 and " " <= flat <= "~" else None


_FORMS = {c: a for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800),
                                  *range(0x1F100, 0x1F200)]) if (a := _ascii_form(c))} | _POINTS
# Beyond the basic plane a range, since single characters there are slow to test.
_ODD = re.compile("[" + re.escape("".join(sorted(c for c in _FORMS if c < "\U00010000")) + "".join(LOOK_ALIKES) + _INVISIBLE)
                  + "\U0001D400-\U0001D7FF\U0001F100-\U0001F1FF]")
_WORD = re.compile(r"[^\W\d_]+")


def homoglyphs(m: Mapped) -> None:
    if m.text.isascii():
        return
    edits, plain = [], (0, -1, False)
    for found in _ODD.finditer(m.text):
        c, i = found[0], found.start()
        if c in _INVISIBLE:
            edits.append((i, i + 1, ""))
        elif c in _FORMS:
            edits.append((i, i + 1, _FORMS[c]))
        elif c in LOOK_ALIKES:
            # a look-alike counts in a word that holds Latin letters and, beside
            # them, nothing but look-alikes
            if i >= plain[1]:
                a, b = _word_at(m.text, i)
                word = m.text[a:b]
                others = [x for x in word if x > "\x7f"]
                plain = (a, b, len(others) < len(word) and all(x in LOOK_ALIKES or x in _FORMS for x in others))
            if plain[2]:
                edits.append((i, i + 1, LOOK_ALIKES[c]))
    m.rewrite(edits)


def _word_at(text: str, i: int) -> Span:
    """The word of letters around place ``i``."""
    a = i
    while a and text[a - 1].isalpha():
        a -= 1
    return a, _WORD.match(text, i).end()


#: Words for the digits 0 to 9 in English, Spanish, French and German.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
               "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve",
               "zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf",
               "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"]
_DIGIT = {w: str(i % 10) for i, w in enumerate(DIGIT_WORDS)} | {"oh": "0"}
_DIGIT_WORD = "(?:" + "|".join(sorted(_DIGIT, key=lambda w: (-len(w), w))) + ")"
_DOT_WORD = r"(?:dot|punto|punkt)"
_DOT_MARK = rf"(?:[ \t]{{0,2}}[\[({{<][ \t]?(?:{_DOT_WORD}|point|\.)[ \t]?[\])}}>][ \t]{{0,2}})"
_AT_MARK = r"(?:[ \t]{0,2}[\[({<][ \t]?(?:at|arroba|@)[ \t]?[\])}>][ \t]{0,2})"
_JOIN = rf"(?:[ \t]?[,-]?[ \t]?|[ \t]{_DOT_WORD}[ \t]|{_DOT_MARK}|[ \t]?\.[ \t]?)"
_SPELLED = re.compile(rf"(?i)(?<!\w){_DIGIT_WORD}(?!\w)(?:{_JOIN}(?<!\w){_DIGIT_WORD}(?!\w)){{3,}}+")
_SPELLED_PART = re.compile(rf"(?i)({_DIGIT_WORD})(?!\w)(?:[ \t]?[,-]?[ \t]?(?=(?<!\w){_DIGIT_WORD}(?!\w)))?")
_PLUS_WORD = re.compile(r"(?i)(?<!\w)plus[ \t]{1,2}$")


def spelled_digits(m: Mapped) -> None:
    # four digit words with no more than a word for a dot between two
    at = [i for i, w in enumerate(_WORD.findall(m.text.lower())) if w in _DIGIT]
    if all(b - a > 6 for a, b in zip(at, at[3:])):
        return
    edits = []
    for run in _SPELLED.finditer(m.text):
        plus = _PLUS_WORD.search(m.text, max(0, run.start() - 8), run.start())
        if plus:
            edits.append((plus.start(), run.start(), "+"))
        edits += [(d.start(), d.end(), _DIGIT[d[1].lower()])
                  for d in _SPELLED_PART.finditer(m.text, run.start(), run.end())]
    m.rewrite(edits)


_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}"
_SPACED_DOT = rf"(?:[ \t]{{1,2}}{_DOT_WORD}[ \t]{{1,2}}|[ \t]{{1,2}}\.[ \t]{{1,2}}|{_DOT_MARK})"
# A bare word is an @ where a label, a spelled dot and a label follow; a point
# with spaces on both sides is a dot unless a capital follows, as in prose.
_AT = re.compile(rf"(?i:{_AT_MARK}|(?<=[A-Za-z0-9_])[ \t]{{1,2}}(?:at|arroba|@)[ \t]{{1,2}}(?={_LABEL}{_SPACED_DOT}[A-Za-z0-9]))")
_DOT = re.compile(rf"(?i:{_DOT_MARK}|(?<=[A-Za-z0-9])[ \t]{{1,2}}{_DOT_WORD}[ \t]{{1,2}}(?=[A-Za-z0-9]))"
                  r"|(?<=[A-Za-z0-9])[ \t]{1,2}\.[ \t]{1,2}(?=[a-z0-9])")
# What every disguise holds, with the character before it: quick to look for.
_AT_CORE = re.compile(r"[ \t\[({<](?:[aA](?:[tT]|[rR][rR][oO][bB][aA])|@)[ \t\])}>]")
_DOT_CORE = re.compile(r"[ \t\[({<](?:\.|(?i:dot|point|punto|punkt))[ \t\])}>]")


def _around(text: str, core: re.Pattern, whole: re.Pattern, new: str) -> list[tuple[int, int, str]]:
    """Matches of ``whole`` that begin at most four characters before one of ``core``."""
    out, free, found = [], 0, core.search(text)
    while found:
        for i in range(max(free, found.start() - 4), found.start() + 1):
            if (m := whole.match(text, i)) and m.end() >= found.end() - 1:
                out.append((*m.span(), new))
                free = m.end()
                break
        found = core.search(text, max(free - 1, found.start() + 1))
    return out


def at_and_dot(m: Mapped) -> None:
    m.rewrite(_around(m.text, _AT_CORE, _AT, "@"))
    m.rewrite(_around(m.text, _DOT_CORE, _DOT, "."))


TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)
_TOP_LEVEL = re.compile(r"\.[A-Za-z]{2,24}$")


def disguised(text: str) -> dict[str, list[Span]]:
    """Source spans of identifiers that only the normalised text shows."""
    m = Mapped(text)
    for transducer in TRANSDUCERS:
        transducer(m)
    out: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if m.start is None:
        return out
    for kind, spans in detect(m.text).items():
        for a, b in spans:
            s, e = m.back((a, b))
            if text[s:e] == m.text[a:b] or kind == "email" and not _TOP_LEVEL.search(m.text, a, b):
                continue
            out[kind].append((s, e))
    return out


# ---- per document ----------------------------------------------------------------

def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            text = text or ""
            base = detect(text)
            own = [(s, k, e) for k, kind in enumerate(KINDS) for s, e in base[kind]]
            more = disguised(text)
            found = {(s, k, e) for k, kind in enumerate(KINDS) for s, e in more[kind]} - set(own)
            rows.append((*(len(base[kind]) for kind in KINDS), hashlib.sha256(_listed(own).encode()).hexdigest(),
                         _listed([*own, *found]), len(found)))
        cols = list(zip(*rows)) or [[]] * (len(KINDS) + 3)
        kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds))],
            ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_disguised"])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_disguised) of every document: counts and digest of the spans in the text
    as it stands, all spans, and how many of them only the normalised text shows.

    A null text is empty: no span.  Spans of different kinds may overlap, a
    disguised one may hold a plain one; repeated rows are each reported; a null
    doc_id stays null; extra columns are ignored; an empty table gives no row.
    """
    ship(docs.sparkSession)
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _report, f"doc_id long, {counts}, base_sha256 string, spans string, n_disguised long")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            spans = [] if not text else sorted(
                {(s, e, kind) for found in (detect(text), disguised(text)) for kind in KINDS for s, e in found[kind]},
                key=lambda x: (x[0], -x[1], KINDS.index(x[2])))
            parts, at = [], 0
            for s, e, kind in spans:
                if s >= at:
                    parts += [text[at:s], f"<{kind}>"]
                at = max(at, e)
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch["row"], batch["text"], pa.array(out, pa.string())], ["row", "text", "masked"])


def masked(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every span, plain or disguised, replaced by
    its kind in angle brackets; overlapping spans by that of the first, the
    longest of those that start there.  A null text stays null."""
    ship(docs.sparkSession)
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(_masked, f"row {kind}, text string, masked string")
    return done.select(*[F.col("masked").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])
