"""Personal data with offsets: base patterns, and patterns behind disguises mapped back to the source.

A transducer rewrites homoglyphs, digits of other scripts, zero-width characters, spelled digits and
plus signs, underscores between groups of four digits and at/dot disguises (in brackets, spaces or
hyphens; a bare "at" before a host name with a known ending only behind a name that has a digit or a
sign, or that a word like "mail" announces, since people also meet at places) while it records, for each character it writes, which source characters it came from. The same patterns
run over what it wrote; a match that holds a rewritten character becomes a span of the source.

Null text counts as empty. Empty text gives no span. Repeated rows each give their own result. A very
long text is searched whole, in time that grows with its length. Spans that start together are
ordered by kind, then end. An empty table gives no rows.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, documents

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: The possessive form and the look-behind change no match; they keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail their test."""
    found: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: Letters of other scripts that look like Latin ones (fixed values), in pairs.
LOOKALIKES = "АAВBЕEКKМMНHОOРPСCТTХXІIЈJЅSаaеeоoрpсcхxуyіiјjѕsԁdһhΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXοoνvıi"
GLYPHS = dict(zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True)) | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | {chr(c): "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
GLYPHS |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Apart from characters beyond the basic plane, which make a slow class.
_GLYPH = re.compile("[" + re.escape("".join(c for c in GLYPHS if c <= "\uffff")) + "]")
_BEYOND = re.compile("[" + re.escape("".join(c for c in GLYPHS if c > "\uffff")) + "]")
_WORD = "|".join(DIGITS)
#: What every token has: a digit's word, the word dot, a bracket before at, @ or a full stop, digits about an underscore, or at before a name with an ending.
_WORD_HINTS = ("dot", *DIGITS)
_HINT = re.compile(r"[\[({<][\x20]?(?:at|@|\.)|[0-9]_[0-9]|[\x20]at[\x20][a-z0-9-]+\.")
#: Endings of host names that "at" may stand before without other disguise, and words that announce an address (fixed values).
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co")
ANNOUNCED = ("mail", "email", "e-mail", "address", "contact")
_TOKENS = re.compile(
    r"(?=[\x20\[({<_pzotfsen-])(?:(?P<digits>(?<![A-Za-z])(?:%(w)s)(?:(?:,[\x20]?|[\x20-]{1,2})(?:%(w)s))*(?![A-Za-z]))"
    r"|(?P<at>[\x20]?[\[({<][\x20]?(?:at|@)[\x20]?[\])}>][\x20]?"
    r"|(?<=[A-Za-z0-9])[\x20]at[\x20](?=[A-Za-z0-9-]+(?:[\x20]dot[\x20]|[\x20]?[\[({<][\x20]?dot[\x20]?[\])}>]))"
    r"|(?<=[A-Za-z0-9])-at-(?=[A-Za-z0-9]+-dot-))"
    r"|(?P<maybe>(?<=[A-Za-z0-9])[\x20]at[\x20](?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:%(e)s)(?![A-Za-z0-9-])))"
    r"|(?P<dot>[\x20]?[\[({<][\x20]?(?:dot|\.)[\x20]?[\])}>][\x20]?|(?<=[A-Za-z0-9])(?:[\x20]dot[\x20]|-dot-)(?=[A-Za-z0-9]))"
    r"|(?P<plus>(?<![A-Za-z])plus[\x20](?=(?:%(w)s)(?![A-Za-z])))"
    r"|(?P<join>(?<=[0-9]{4})_(?=[0-9]{4})))" % {"w": _WORD, "e": "|".join(ENDINGS)},
    re.IGNORECASE | re.ASCII,
)
_WRITTEN = {"at": "@", "maybe": "@", "dot": ".", "plus": "+", "join": "-"}
_SPECIAL = re.compile(r"[0-9._%+-]")
_BEFORE = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(ANNOUNCED)})(?:[\x20](?:is|to))?:?[\x20]\Z", re.IGNORECASE | re.ASCII)


def _addressed(plain: str, end: int) -> bool:
    """Whether what stands before a bare "at" is an address's name rather than a word: it has a digit or a sign, or is announced."""
    start = end
    while start > max(0, end - 64) and plain[start - 1] in _LOCAL:
        start -= 1
    return _SPECIAL.search(plain, start, end) is not None or _BEFORE.search(plain[max(0, start - 16) : start]) is not None


#: What may stand between a short run of spelled digits and its neighbours.
_GAP = "\x20().+-"
_ONE = re.compile(rf"(?:{_WORD})", re.IGNORECASE)


def _tokens(plain: str) -> list[re.Match]:
    """Matches of _TOKENS; fewer than three spelled digits count beside digits, other spelled ones or a dot, a bare "at" behind a name."""
    found = list(_TOKENS.finditer(plain))

    def counts(i: int, m: re.Match) -> bool:
        if m.lastgroup == "maybe":
            return _addressed(plain, m.start())
        if m.lastgroup != "digits" or len(_ONE.findall(m[0])) > 2:
            return True
        before = plain[max(0, m.start() - 3) : m.start()].rstrip(_GAP)[-1:]
        after = plain[m.end() : m.end() + 3].lstrip(_GAP)[:1]
        if (before and before in "0123456789") or (after and after in "0123456789"):
            return True
        beside = []
        if i and m.start() - found[i - 1].end() <= 2:
            beside.append((found[i - 1], plain[found[i - 1].end() : m.start()]))
        if i + 1 < len(found) and found[i + 1].start() - m.end() <= 2:
            beside.append((found[i + 1], plain[m.end() : found[i + 1].start()]))
        return any(n.lastgroup in ("digits", "dot") and not gap.strip(_GAP) for n, gap in beside)

    return [m for i, m in enumerate(found) if counts(i, m)]


def deobfuscate(text: str) -> tuple[str, list[int], list[int]] | None:
    """The rewritten text with, per character of it, source start and end; None if nothing is disguised.

    A written character is a rewritten one if its source differs from it.
    """
    glyphs = not text.isascii() and (_GLYPH.search(text) is not None or (max(text) > "\uffff" and _BEYOND.search(text) is not None))
    plain, starts = text, None
    if glyphs:
        out, starts = [], []
        for i, c in enumerate(text):
            for x in GLYPHS.get(c, c):
                out.append(x)
                starts.append(i)
        plain = "".join(out)
    lower = plain.lower()
    hinted = any(h in lower for h in _WORD_HINTS) or _HINT.search(lower) is not None
    tokens = _tokens(plain) if hinted else []
    if not glyphs and not tokens:
        return None
    if starts is None:
        starts = list(range(len(text)))
    ends = [s + 1 for s in starts]
    if not tokens:
        return plain, starts, ends
    out, begin, end, done = [], [], [], 0
    for m in tokens:
        out.append(plain[done : m.start()])
        begin += starts[done : m.start()]
        end += ends[done : m.start()]
        if m.lastgroup == "digits":
            for d in _ONE.finditer(plain, m.start(), m.end()):
                out.append(DIGITS[d[0].lower()])
                begin.append(starts[d.start()])
                end.append(ends[d.end() - 1])
        else:
            out.append(_WRITTEN[m.lastgroup])
            begin.append(starts[m.start()])
            end.append(ends[m.end() - 1])
        done = m.end()
    out.append(plain[done:])
    return "".join(out), begin + starts[done:], end + ends[done:]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those found behind disguises; both in order.

    A span behind a disguise is left out where a base span of its kind covers it.
    """
    base = base_spans(text)
    spans = base
    if (rewritten := deobfuscate(text)) is not None:
        plain, begin, end = rewritten
        more = []
        for kind, a, b in base_spans(plain):
            s, e = begin[a], end[b - 1]
            if text[s:e] != plain[a:b] and not any(k == kind and x <= s and e <= y for k, x, y in base):
                more.append((kind, s, e))
        spans = base + more
    order = lambda x: (x[1], RANK[x[0]], x[2])
    return sorted(base, key=order), sorted(spans, key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[done:start], f"<{kind.upper()}>"]
        done, i = end, i + 1
    return "".join(out) + text[done:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base_spans and spans (arrays of kind, start, end) and redacted (text; null stays null)."""

    def make():
        def compute(texts):
            pairs = [all_spans(t or "") for t in texts]
            return [a for a, _ in pairs], [b for _, b in pairs], [t if t is None else redact(t, b) if b else t for t, (_, b) in zip(texts, pairs, strict=True)]

        return compute

    fields = [T.StructField("base_spans", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())]
    return append_columns(df, [text], [*fields], lambda: _as_dicts(make()))


def _as_dicts(compute):
    def run(texts):
        base, spans, redacted = compute(texts)
        rows = lambda xs: [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in xs]
        return rows(base), rows(spans), redacted

    return run


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "base_spans", "spans")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
