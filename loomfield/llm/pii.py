"""PII with offset-preserving deobfuscation.

Base spans come from the text as it stands. Then a chain of transducers rewrites the
text, each with a source offset for every character it puts out:

1. characters: compatibility forms (full width, mathematical, circled) to what they
   stand for, look-alikes of ASCII letters to those, invisible ones to nothing;
2. digits: runs of three or more spelled or written ones ("double five", "oh") to
   digits, and O, o, l, I, | among digits to 0 and 1;
3. signs: "plus" before a digit, bracketed "at" and "dot";
4. chains: numbers joined by " dot " or " . ", and addresses whose sign is a word or
   stands apart, with any number of labels on both sides.

Identifiers are looked for in what it wrote, and their spans go back to the source
through the offsets. Found spans that no base span of their kind touches, or that are
longer than the base spans they touch and contain them, are added.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: a match has its sign where the local part's run ends,
    so it is found from the sign outwards, in time linear in the text."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > end and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = t.find("@", at + 1)
    return out


def ips(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


_TWICE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(_TWICE[x] for x in d[1::2])) % 10 == 0


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    if "+" not in t:
        return []
    return [m.span() for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Look-alikes of ASCII letters in Cyrillic and Greek, and of signs.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", " ": " ", " ": " ", " ": " ", "​": "", "⁠": "", "­": "",
}
_ODD = re.compile(r"[^\x00-\x7f]")


@functools.lru_cache(1 << 16)
def plain(c: str) -> str:
    """What a character stands for, itself where that isn't ASCII."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    form = unicodedata.normalize("NFKC", c)
    return HOMOGLYPHS.get(form, form) if form in HOMOGLYPHS or form.isascii() else c


# Digits in words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
_WORD = rf"(?:(?:{'|'.join(TIMES)})\x20+)?(?:{'|'.join(SPELLED)})"
# From its first word on; digits before it are found by walking back.
_SPELLED_RUN = re.compile(rf"(?i)\b{_WORD}\b(?:[\x20,-]+(?:{_WORD}\b|[0-9]+))*")
_DIGITS, _BETWEEN = frozenset("0123456789"), frozenset(" ,-")
_PART = re.compile(rf"(?i)(?:({'|'.join(TIMES)})\x20+)?({'|'.join(SPELLED)})|[0-9]+")
_ANY_WORD = re.compile("(?i)" + "|".join(SPELLED))
_LIKE = str.maketrans("OolI|", "00111")
# Runs with both kinds, looked at from where a run begins only.
_LIKE_RUN = re.compile(r"(?<![0-9OolI|])(?=[OolI|]*+[0-9])(?=[0-9]*+[OolI|])[0-9OolI|]++")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_PLUS = re.compile(r"(?i)\bplus[\x20-]+(?=[0-9])")
_SIGN = re.compile(r"(?i)\x20?[\[({<]\x20?(at|dot|@|\.)\x20?[\])}>]\x20?")
# What no match of _SIGN is without; quicker to look for.
_SIGN_HINT = re.compile(r"(?i)[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]")
_NUMBERS = re.compile(r"(?i)(?<![0-9])[0-9]+(?:\x20+(?:dot|\.)\x20+[0-9]+){3}(?![0-9])")
_APART = re.compile(r"(?i)\x20+(?:dot|\.)\x20+")
_AT = re.compile(r"(?i)(?<!\x20)\x20++(?:(at)|@)\x20++|(?<!\x20)\x20++@|@\x20++")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_STEP = re.compile(r"(?i)(\x20+(?:dot|\.)\x20+|\.)[A-Za-z0-9-]+")
_LOCAL_STEP = re.compile(r"(?i)\x20dot\x20\Z")


class Tape:
    """What a transducer has written, and where in the source each character begins
    and ends."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (from, to, put instead) in order, without overlap."""
        if not edits:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            begin += self.begin[at:a]
            end += self.end[at:a]
            begin += [self.begin[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.begin, self.end = begin + list(self.begin[at:]), end + list(self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.begin[a], self.end[b - 1]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled and written digits that hold a spelled one: from each first word
    outwards, so numbers without one are passed over once."""
    edits, end = [], 0
    for m in _SPELLED_RUN.finditer(text):
        start = at = m.start()
        while True:
            a = at
            while a > end and text[a - 1] in _BETWEEN:
                a -= 1
            z = a
            while z > end and text[z - 1] in _DIGITS:
                z -= 1
            # digits that go on to the left in another word are no number of their own
            if a == at or z == a or (z and (text[z - 1].isalnum() or text[z - 1] == "_")):
                break
            start = at = z
        end = m.end()
        put = "".join(SPELLED[p[2].lower()] * TIMES.get((p[1] or "").lower(), 1) if p[2] else p[0] for p in _PART.finditer(text, start, end))
        if len(put) >= 3:
            edits.append((start, end, put))
    return edits


def _likes(text: str) -> list[tuple[int, int, str]]:
    """Digits and their look-alikes that stand alone, both kinds in one run. A run may
    begin and end beside a bar, which is a look-alike and no letter."""
    edits = []
    for m in _LIKE_RUN.finditer(text):
        a, z = m.span()
        if a and text[a - 1] in _ALNUM:
            a = text.find("|", a, z) + 1
            if not a:
                continue
        rest = text[a : m.end()]
        if z < len(text) and text[z] in _ALNUM:
            z = text.rfind("|", a + 1, z)
        if z > a and not rest.isdigit() and any(c in _DIGITS for c in rest):
            edits.append((a, z, text[a:z].translate(_LIKE)))
    return edits


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that close up addresses whose sign is the word "at" or stands apart. A word
    needs a dot that is a word or stands apart too; a sign needs some dot."""
    edits, end = [], 0
    for m in _AT.finditer(text):
        a, at = m.span()
        first = _LABEL.match(text, at)
        if a < end or not first or not a or text[a - 1] not in _LOCAL:
            continue
        steps, stop = [], first.end()
        while step := _STEP.match(text, stop):
            steps.append(step.span(1))
            stop = step.end()
        if not steps or (m[1] and all(z - x == 1 for x, z in steps)):
            continue
        before, start = [], a
        while True:  # the local part, and the words that "dot" joins before it
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start - 6 < end or not _LOCAL_STEP.search(text, start - 5, start) or text[start - 6] not in _LOCAL:
                break
            before.append((start - 5, start, "."))
            start -= 5
        edits += [*before[::-1], (a, at, "@"), *((x, z, ".") for x, z in steps if z - x > 1)]
        end = stop
    return edits


def deobfuscate(t: str) -> Tape | None:
    """The rewritten text, or None where nothing is to be rewritten."""
    tape = Tape(t)
    if not t.isascii():
        tape.rewrite([(m.start(), m.end(), p) for m in _ODD.finditer(t) if (p := plain(m[0])) != m[0]])
    if _ANY_WORD.search(tape.text):
        tape.rewrite(_spelled(tape.text))
    tape.rewrite(_likes(tape.text))
    # each rule is run where its text has what none of its matches is without; a long s counts as an s in any case
    low = tape.text.lower()
    if "plus" in low or "pluſ" in low:
        tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    if _SIGN_HINT.search(tape.text):
        tape.rewrite([(m.start(), m.end(), {"at": "@", "dot": "."}.get(m[1].lower(), m[1])) for m in _SIGN.finditer(tape.text)])
    if " dot " in low or " . " in low:
        tape.rewrite([(x.start(), x.end(), ".") for m in _NUMBERS.finditer(tape.text) for x in _APART.finditer(tape.text, m.start(), m.end())])
    if " at " in low or "@" in tape.text:
        tape.rewrite(_addresses(tape.text))
    return tape if tape.text is not t else None


def spans(t: str) -> tuple[list, list]:
    """(base, all) spans as (start, kind number, end), in order."""
    base, more = [], []
    tape = deobfuscate(t)
    for k, kind in enumerate(KINDS):
        own = FINDERS[kind](t)
        base += [(a, k, b) for a, b in own]
        if tape is not None:
            starts = [a for a, _ in own]
            for a, b in FINDERS[kind](tape.text):
                a, b = tape.source(a, b)
                i = j = bisect_left(starts, b)
                while j and own[j - 1][1] > a:
                    j -= 1
                met = own[j:i]  # base spans of this kind that touch it
                if not met or (a <= met[0][0] and met[-1][1] <= b and met != [(a, b)]):
                    more.append((a, k, b))
    base.sort()
    return base, sorted(base + more)


def _join(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches):
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        sha, said = [], []
        for t in b.column(1).to_pylist():
            base, found = spans(t)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(_join(base).encode()).hexdigest())
            said.append(_join(found))
        yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(said)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (kind:start:end in code points, end exclusive, comma-joined).

    Null and empty texts have no spans. Rows are judged one by one, so repeated rows
    give repeated results and order doesn't matter. Other columns are ignored.
    """
    return common.id_text(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(common.documents(spark, sf_dir))
