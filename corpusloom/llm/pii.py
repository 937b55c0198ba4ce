"""PII detection through offset-preserving deobfuscation.

A text passes through a chain of transducers.  Each rewrites a string and
carries, for every character it emits, the range of source characters that
character stands for:

1. ``fold``: homoglyphs (Cyrillic, Greek, full-width and mathematical forms)
   become ASCII, exotic dashes and blanks become ``-`` and a blank, and
   zero-width characters vanish;
2. ``digits``: runs of seven or more spelled digits (English, German, French,
   Spanish; "double" and "triple" and numerals of any length too) become digits;
3. ``at_dot``: "name [at] host (dot) tld", "name at host dot tld", "name at
   host.tld" and their kin become ``name@host.tld``.

Left out on purpose: "name at host" with an end that is neither a country's
nor listed; "name at host" after one of ``_PROSE`` ("look at example.com",
"visit us at example dot com"); disguises with more than 8 blanks in a row, hosts
of more than 10 labels and local parts beyond ``_WINDOW`` characters (addresses
have 64 at most); numbers of a card's length that fail Luhn's check;
runs of fewer than five tokens, or three if one is a numeral of two or more
digits, and such a numeral beside one digit word only ("555-4974, un ..."); runs that repeat one to three digits ("un un un ..."); Spanish
groups of three parted by dots (thousands); bare numbers not spelled out.

Identifiers are detected in what comes out, and their spans are mapped back to
source characters, so a redaction replaces exactly the disguised passage.

Offsets count Unicode characters, ``begin`` inclusive and ``end`` exclusive.
Spans never overlap: the one that begins first wins, then the longer one,
then the kind named first in ``KINDS``.

Defined results: null and empty texts have no findings and are left as they
are; repeated rows each give their findings; a null ``doc_id`` is carried
along; an empty table gives an empty result; whole texts of any length are
scanned; ``find`` reads only ``doc_id`` and ``text``, and ``redact`` touches
only ``text`` and ``n_chars``, whatever other columns there are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.textkit import column, pieces, slices, word_hashes

KINDS = ("email", "secret", "iban", "ip", "card", "phone", "ssn")
SCHEMA = "doc_id long, kind string, begin int, end int, surface string, normal string"

_CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝкмтвнАВЕКМНОРСТХУІЈЅ", "aeopcyxijshdqwkmtbhABEKMHOPCTXYIJS"))
_GREEK = dict(zip("αοερτυνικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoeptuvikxABEZHIKMNOPTYX"))
_ZERO_WIDTH = [*map(chr, (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0xAD, 0x180E))]
_DASHES = [*map(chr, (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D))]
_BLANKS = [*map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))]
_GONE = 0xFFFFFFFF


def _fold_table() -> np.ndarray:
    lut = np.arange(0x20000, dtype=np.uint32)
    for c in _ZERO_WIDTH:
        lut[ord(c)] = _GONE
    for c, to in [*_CYRILLIC.items(), *_GREEK.items(), *((c, "-") for c in _DASHES), *((c, " ") for c in _BLANKS)]:
        lut[ord(c)] = ord(to)
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500), (0x2070, 0x20A0), (0x24B6, 0x24EA)):
        for cp in range(lo, hi):
            to = unicodedata.normalize("NFKC", chr(cp))
            if len(to) == 1 and to.isascii():
                lut[cp] = ord(to)
    return lut


_FOLD = _fold_table()
_FOLDED = np.append(_FOLD != np.arange(len(_FOLD)), False)

_DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0",
    "ein": "1",
    "zwo": "2",
    "fuenf": "5",
    "une": "1",
}
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
_ANY_WORD = "(?:" + "|".join(sorted([*_DIGIT_WORDS, *_TIMES], key=len, reverse=True)) + ")"
_ANY_DIGIT = rf"(?:{_ANY_WORD}|[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_ANY_DIGIT}[\s,.\-]+){{2,}}{_ANY_DIGIT}(?!\w)", re.I)
_SPELLED_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+")
_NUMERAL = re.compile(r"[0-9]{2,}")
_MIXED_HINT = re.compile(rf"(?<!\w)(?:[0-9]{{2,}}[\s,.\-]+{_ANY_WORD}(?!\w)|{_ANY_WORD}[\s,.\-]+[0-9]{{2,}})", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_WORD, _DOT_WORD = "(?:at|arroba|ät)", "(?:dot|punkt|punto|point)"
#: Blanks that a disguise may hold in a row.
_GAP = r"\s{0,8}"
_AT_MARK = re.compile(rf"{_OPEN}{_GAP}(?:{_AT_WORD}|@){_GAP}{_CLOSE}|@|(?<=\s){_AT_WORD}(?=\s)", re.I)
_DOT_B = rf"{_GAP}{_OPEN}{_GAP}(?:{_DOT_WORD}|\.){_GAP}{_CLOSE}{_GAP}"
_DOT_PLAIN = rf"\s{{1,8}}{_DOT_WORD}\s{{1,8}}"
#: A host is a few labels of at most 63 characters.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_LABELS = "{1,9}"
_LOCAL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
#: Characters before an at that are searched for a local part (64 at most, and their disguise).
_WINDOW = 256
#: Ends that make "name at host dot tld" an address; without brackets the words alone are prose.
_TLD = "(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|me|tv|eu|uk|us|ca|au|de|at|ch|fr|es|it|nl|be|pt|pl|se|no|dk|fi|ru|cn|jp|kr|in|br|mx|ar|example|test"
_TLD += "|name|pro|xyz|online|site|shop|store|tech|cloud|blog|email|cat"
_TLD += "".join(f"|{a}[{b}]" for a, b in zip("abcdefghijklmnopqrstuvwyz", (
    "cdefgilmoqrstuwxz abdefghijmnorstvwyz acdfghiklmnoruvwxyz ejkmoz cegrstu ijkmor abdefghilmnpqrstuwy kmnrtu delmnoqrst emop "
    "eghimnprwyz abcikrstuvy acdeghklmnopqrstuvwxyz acefgilopruz m aefghklmnrstwy a eosuw abcdeghijklmnorstvxyz cdfghjklmnortvwz agksyz "
    "aceginu fs et amw").split())) + ")"
#: Words that stand before "at host.tld" in prose.
_PROSE = "look|looks|looked|looking|us|me|it|them|him|her|find|found|available|visit|see|read|more|online|live|hosted|here|is|are|was|were|and|or|page|site|website|news"
_HOST_1 = re.compile(rf"{_LABEL}(?:(?:{_DOT_B}|{_DOT_PLAIN}|\.){_LABEL}){_LABELS}(?!\w)", re.I)
_HOST_2 = re.compile(rf"{_LABEL}(?:(?:{_DOT_B}|{_DOT_PLAIN}){_LABEL}){{0,8}}(?:{_DOT_B}|{_DOT_PLAIN}){_TLD}(?!\w)", re.I)
_HOST_3 = re.compile(rf"{_LABEL}(?:(?:{_DOT_B}|{_DOT_PLAIN}|\.){_LABEL}){{0,8}}\.{_TLD}(?!\w)", re.I)
_DOT_WORD_BACK = "(?:" + "|".join(x[::-1] for x in ("dot", "punkt", "punto", "point")) + ")"
_DOT_BACK = rf"(?:{_GAP}{_CLOSE}{_GAP}(?:{_DOT_WORD_BACK}|\.){_GAP}{_OPEN}{_GAP}|\s{{1,8}}{_DOT_WORD_BACK}\s{{1,8}})"
#: A local part read from its end.
_LOCAL_BACK = re.compile(rf"{_LOCAL}(?:{_DOT_BACK}{_LOCAL})*(?![\w.])", re.I)
_AT_HOST_HINT = re.compile(rf"\s{_AT_WORD}\s{{1,8}}{_LABEL}(?:\.|{_GAP}{_OPEN}|{_DOT_PLAIN})", re.I)
_PROSE_LOCAL = re.compile(_PROSE, re.I)
_DOTS = re.compile(rf"{_DOT_B}|{_DOT_PLAIN}", re.I)
_AT_DOT_HINT = re.compile(rf"\b{_DOT_WORD}\b|{_OPEN}{_GAP}(?:{_AT_WORD}|{_DOT_WORD}|@|\.){_GAP}{_CLOSE}|\s@|@\s", re.I)

_DETECTORS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    (
        "secret",
        re.compile(
            r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])|\bgh[pousr]_[A-Za-z0-9]{30,}|\bsk_(?:live|test)_[A-Za-z0-9]{16,}"
            r"|\bxox[abprs]-[A-Za-z0-9-]{10,}|(?<![\w-])eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}"
            r"|(?<=[=:])[ \t]*[\"']?[0-9a-f]{16,}[\"']?(?![0-9a-zA-Z])|\b[0-9a-f]{32,}\b"
            r"|(?i:(?:password|passwd|pwd|secret|api_?key|token)[ \t]*[=:][ \t]*[\"']?[^\s\"']{6,}[\"']?)"
        ),
    ),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w)")),
    ("card", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    (
        "phone",
        re.compile(
            r"(?<![\w.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
            r"|\d{3}[ .-]\d{3}[ .-]\d{4}|0[1-9](?:[ .-]\d{2}){4}|[6-9]\d{2}(?:[ -]\d{3}){2}|[6-9]\d{2}(?:[ -]\d{2}){3}|0\d{2,4}[ /.-]\d{3,4}[ .-]?\d{2,5})(?!\w)"
        ),
    ),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
]
_NEEDS_DIGIT = {"secret", "iban", "ip", "card", "phone", "ssn"}
#: A secret without digits holds one of these.
_KEY_MARKS = ("=", ":", "AKIA", "_", "xox", "eyJ")
_DIGIT = re.compile(r"[0-9]")
_BARE = re.compile(r"(?<![\w.])\d{7,12}(?!\w)")


def fold(text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """Folded text and, unless unchanged, source begin and end of each character."""
    if text.isascii():
        return text, None, None
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not _FOLDED[np.minimum(cp, len(_FOLD))].any():
        return text, None, None
    to = np.where(cp < len(_FOLD), _FOLD[np.minimum(cp, len(_FOLD) - 1)], cp)
    keep = to != _GONE
    at = np.flatnonzero(keep)
    return to[keep].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), at, at + 1


Edit = tuple[int, int, str]


def rewrite(
    text: str, begin: np.ndarray | None, end: np.ndarray | None, edits: list[Edit]
) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """Replace spans of ``text``; each new character stands for its whole span."""
    if not edits:
        return text, begin, end
    if begin is None:
        begin = np.arange(len(text))
        end = begin + 1
    out, bs, es, at = [], [], [], 0
    for b, e, new in edits:
        out += [text[at:b], new]
        bs += [begin[at:b], np.full(len(new), begin[b])]
        es += [end[at:b], np.full(len(new), end[e - 1])]
        at = e
    out.append(text[at:])
    return "".join(out), np.concatenate([*bs, begin[at:]]), np.concatenate([*es, end[at:]])


def _word_lut(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(words)[0]
    lut = np.zeros(1 << 16, dtype=bool)
    lut[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
    return lut, np.unique(h)


def _are(h: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions of ``h`` that are one of ``words``."""
    at = np.flatnonzero(words[0][(h & np.uint64(0xFFFF)).astype(np.int64)])
    return at[np.isin(h[at], words[1])]


_DIGIT_HASHES = _word_lut([*_DIGIT_WORDS, *_TIMES, *"0123456789"])
_DOT_HASHES = _word_lut(["dot", "punkt", "punto", "point"])
_AT_HASHES = _word_lut(["at", "arroba", "ät"])


def _mixed(text: str) -> bool:
    """Does a digit word stand beside a numeral of two or more digits?"""
    return any(_MIXED_HINT.search(text, max(0, m.start() - 12), m.end() + 12) for m in _NUMERAL.finditer(text))


def hints(folded: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each folded text: can it hold a run of spelled digits, or an at/dot disguise?

    Both are necessary conditions, found on the word hashes of the whole batch.
    """
    spelled = np.zeros(len(folded), dtype=bool)
    disguised = np.zeros(len(folded), dtype=bool)
    for part in pieces(folded):
        h, off = word_hashes(folded[part])
        at = _are(h, _DIGIT_HASHES)
        if len(at) >= 5:
            # seven digits may be five words ("triple four double five six")
            run = at[4:] - at[:-4] == 4
            doc = np.searchsorted(off, at[:-4][run], side="right") - 1
            spelled[part.start + doc] = True
        doc = np.unique(np.searchsorted(off, at, side="right") - 1)
        for i in (part.start + doc).tolist():
            spelled[i] = spelled[i] or _mixed(folded[i])
        doc = np.searchsorted(off, _are(h, _DOT_HASHES), side="right") - 1
        disguised[part.start + doc] = True
        doc = np.unique(np.searchsorted(off, _are(h, _AT_HASHES), side="right") - 1)
        for i in (part.start + doc).tolist():
            disguised[i] = disguised[i] or _AT_HOST_HINT.search(folded[i]) is not None
    for i, t in enumerate(folded):
        if t and not disguised[i] and ("@" in t or "[" in t or "(" in t or "{" in t or "<" in t):
            disguised[i] = _AT_DOT_HINT.search(t) is not None
    return spelled, disguised


def spelled_edits(text: str) -> list[Edit]:
    """One edit for each digit of every run of seven or more spelled digits.

    A digit's span reaches to the next one, so separators vanish.  Runs with
    no digit word at all are left to the detectors; runs that repeat their
    first one to three digits are taken for repeated words ("un un un ...").
    """
    edits: list[Edit] = []
    for run in _SPELLED_RUN.finditer(text):
        tokens = list(_SPELLED_TOKEN.finditer(text, run.start(), run.end()))
        numerals = [m[0] for m in tokens if m[0].isdigit()]
        if len(tokens) == len(numerals):
            continue
        if len(tokens) < 5 if all(len(x) == 1 for x in numerals) else len(tokens) - len(numerals) < 2:
            continue
        made: list[Edit] = []
        times, begin = 1, None
        for i, m in enumerate(tokens):
            word = m[0].lower()
            begin = m.start() if begin is None else begin
            if word in _TIMES:
                times = _TIMES[word]
                continue
            stop = tokens[i + 1].start() if i + 1 < len(tokens) else m.end()
            made.append((begin, stop, _DIGIT_WORDS.get(word, m[0]) * times))
            times, begin = 1, None
        number = "".join(x[2] for x in made)
        if len(number) >= 7 and not any(number == (number[:k] * len(number))[: len(number)] for k in (1, 2, 3)):
            edits += made
    return edits


def _before(text: str, least: int, end: int) -> int | None:
    """Where the local part that ends at ``end`` begins, not before ``least``."""
    low = max(least, end - _WINDOW)
    m = _LOCAL_BACK.match(text[low:end][::-1])
    if m is None or m.end() == end - low and low > 0 and (low > least or text[low - 1] == "." or text[low - 1].isalnum()):
        return None
    return end - m.end()


def at_dot_edits(text: str) -> list[Edit]:
    """Edits that undo at/dot disguises inside address-shaped passages.

    Each at is read outwards: first a host after it, then a local part before
    it, both of bounded length, so the time is linear in the text.
    """
    edits: list[Edit] = []
    done = 0
    for mark in _AT_MARK.finditer(text):
        begin, end = mark.span()
        if begin < done:
            continue
        plain = mark[0][0].isalpha()
        after, before = end, begin
        while after < len(text) and after - end < 8 and text[after].isspace():
            after += 1
        while before > done and begin - before < 8 and text[before - 1].isspace():
            before -= 1
        hosts = (_HOST_2, _HOST_3) if plain else (_HOST_1,)
        host = next((m for rx in hosts if (m := rx.match(text, after))), None)
        if host is None:
            continue
        start = _before(text, done, before)
        if start is None or plain and _PROSE_LOCAL.fullmatch(text, start, before):
            continue
        for a, b in ((start, before), host.span()):
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, a, b)]
        if text[before:after] != "@":
            edits.append((before, after, "@"))
        done = host.end()
    return sorted(edits)


Normal = tuple[str, np.ndarray | None, np.ndarray | None]


def normalise(texts: list[str | None]) -> Iterator[Normal | None]:
    """All transducers in turn: normal text, source begins and ends (None: identity)."""
    folded = [fold(t) if t else None for t in texts]
    spelled, disguised = hints([f[0] if f else None for f in folded])
    for i, f in enumerate(folded):
        if f and spelled[i]:
            f = rewrite(*f, spelled_edits(f[0]))
        if f and disguised[i]:
            f = rewrite(*f, at_dot_edits(f[0]))
        yield f


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    n = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
    return 15 <= len(s) <= 34 and int(n) % 97 == 1


def _card_ok(s: str) -> bool:
    """Luhn's check of a card number."""
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


Finding = tuple[str, int, int, str]


def _detect(text: str, normal: Normal) -> list[Finding]:
    s, b, e = normal
    digit = bool(_DIGIT.search(s))
    mail = "@" in s
    if not digit and not mail and not any(x in s for x in _KEY_MARKS):
        return []
    found = []
    for rank, (kind, rx) in enumerate(_DETECTORS):
        if kind == "email" and not mail or kind in _NEEDS_DIGIT - {"secret"} and not digit:
            continue
        for m in rx.finditer(s):
            if kind == "iban" and not _iban_ok(m[0]) or kind == "card" and not _card_ok(m[0]):
                continue
            x, y = m.span()
            x += len(m[0]) - len(m[0].lstrip())
            found.append((x, x - y, rank, kind, y))
    if e is not None and digit:
        # A bare number is a phone number only if it was spelled out.
        for m in _BARE.finditer(s):
            x, y = m.span()
            if any(c.isalpha() for c in text[b[x] : e[y - 1]]):
                found.append((x, x - y, len(_DETECTORS), "phone", y))
    out, at = [], 0
    for x, _, _, kind, y in sorted(found):
        if x >= at:
            at = y
            out.append((kind, int(x if b is None else b[x]), int(y if e is None else e[y - 1]), s[x:y]))
    return out


def detect(texts: list[str | None]) -> Iterator[list[Finding]]:
    """``kind, begin, end, normal`` of each text's findings, in source order."""
    for t, normal in zip(texts, normalise(texts)):
        yield _detect(t, normal) if normal else []


def redacted(text: str | None, found: list[Finding]) -> str | None:
    """The text with each finding replaced by its kind in brackets."""
    if not found:
        return text
    out, at = [], 0
    for kind, b, e, _ in found:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, begin, end, surface, normal`` of every finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = column(batch, "doc_id")
            rows: list[tuple] = []
            texts = column(batch, "text")
            for i, found in enumerate(detect(texts)):
                rows += [(ids[i], k, b, e, texts[i][b:e], n) for k, b, e, n in found]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            cols = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "kind", "begin", "end", "surface", "normal"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding redacted and ``n_chars`` counted anew."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text")
            new = [redacted(t, found) for t, found in zip(texts, detect(texts))]
            at = columns.index("text")
            batch = batch.set_column(at, "text", pa.array(new, pa.string()))
            if "n_chars" in columns:
                at = columns.index("n_chars")
                old = column(batch, "n_chars")
                n = [o if x is t or x == t else len(x) for o, x, t in zip(old, new, texts)]
                batch = batch.set_column(at, "n_chars", pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
