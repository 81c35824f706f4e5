"""Personal data: exact base patterns, and disguises found by offset-preserving deobfuscation.

Base spans come from the text itself. Then transducers rewrite homoglyphs, zero-width characters,
spelled digits and at/dot disguises into a normalised text in which each character knows its source
span; the same patterns run on that text and their matches are mapped back. A mapped span is added
only where it overlaps no base span.

Each pattern reads a text in time linear in its length: an email is found from its ``@`` and its
local part read backwards; digit runs are entered only at their start.

Edge cases: null text is empty and has no spans; offsets are code points, ends exclusive; spans of
different kinds may overlap, and are all listed; a very long text is read whole, in time that grows with
its length; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones, then marks that look like @ and the full stop.
_LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "。": ".", "․": "."}
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _glyphs() -> dict[str, str]:
    """By compatibility normalisation: every wide, mathematical or circled form of one ASCII character, and the lookalikes."""
    ranges = ((0x2070, 0x209D), (0x2460, 0x24EB), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for lo, hi in ranges for c in range(lo, hi))
    return {c: n for c, n in forms if len(n) == 1 and n.isascii()} | _LOOKALIKES


_GLYPHS = _glyphs()
_CASED = str.maketrans("ſıİ", "sii")  # beside the two cases, what an s or i matches where case is ignored
_ODD = frozenset(_GLYPHS) | frozenset(_INVISIBLE) | frozenset("ſıİ")
_ONE_TO_ONE = str.maketrans(_GLYPHS)
_NUMBER = "(?:" + "|".join(_NUMBERS) + ")"
_RULES = re.compile(
    rf"(?P<at>\s{{0,2}}[\[({{<]\s{{0,2}}(?:at|@)\s{{0,2}}[\])}}>]\s{{0,2}}|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+|\s{{0,2}}[\[({{<]\s{{0,2}}dot\s{{0,2}}[\])}}>]\s{{0,2}})[A-Za-z]))"
    rf"|(?P<dot>\s{{0,2}}[\[({{<]\s{{0,2}}(?:dot|\.)\s{{0,2}}[\])}}>]\s{{0,2}}|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus[\s-]+(?={_NUMBER}\b))"
    rf"|(?P<digits>\b{_NUMBER}(?:[\s,-]{{1,3}}{_NUMBER})+\b)"
    rf"|(?P<gone>[{_INVISIBLE}])",
    re.IGNORECASE,
)
# What a match of _RULES holds, in lower case: a bracketed mark, a spaced dot, or a spelled digit after another or after plus.
_BRACKETED = re.compile(r"[\[({<]\s{0,2}(?:at|@|dot|\.)\s{0,2}[\])}>]")
_SPACED = re.compile(r"\sdot\s")
_SPELLED = re.compile(rf"(?:{_NUMBER}[\s,-]{{1,3}}|plus[\s-]+){_NUMBER}")
_WORD_OF = re.compile(_NUMBER, re.IGNORECASE)


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and then start."""
    out = []
    if "@" in t:
        done = 0
        for m in _DOMAIN.finditer(t):
            lo = m.start()
            while lo > done and _LOCAL_END.match(t[lo - 1]):
                lo -= 1
            if lo < m.start():
                out.append(("email", lo, m.end()))
                done = m.end()
    if _DIGIT.search(t):
        if "." in t:
            out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            if len(m[0]) >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def normalise(t: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The normalised text, and its pieces as (place in it, source start, source end); a piece of as many characters on both sides maps one to one."""
    t = t.translate(_ONE_TO_ONE)
    out, pieces, at, size = [], [], 0, 0

    def put(s: str, lo: int, hi: int) -> None:
        nonlocal size
        if s:
            pieces.append((size, lo, hi))
            out.append(s)
            size += len(s)

    for m in _RULES.finditer(t):
        put(t[at : m.start()], at, m.start())
        lo, hi = m.span()
        if m["at"]:
            put("@", lo, hi)
        elif m["dot"]:
            put(".", lo, hi)
        elif m["plus"]:
            put("+", lo, hi)
        elif m["digits"]:
            for w in _WORD_OF.finditer(t, lo, hi):
                put(_NUMBERS[w[0].translate(_CASED).lower()], *w.span())
        at = hi
    put(t[at:], at, len(t))
    return "".join(out), pieces


def _source(pieces: list[tuple[int, int, int]], size: int, lo: int, hi: int) -> tuple[int, int]:
    """The source span of the normalised span lo:hi."""
    def place(i: int) -> tuple[int, int]:
        k = bisect_right(pieces, i, key=lambda p: p[0]) - 1
        at, a, b = pieces[k]
        n = (pieces[k + 1][0] if k + 1 < len(pieces) else size) - at
        return (a + i - at, a + i - at + 1) if n == b - a else (a, b)

    return place(lo)[0], place(hi - 1)[1]


def _disguised(t: str) -> bool:
    """Whether the transducers could change the text: true wherever _RULES matches."""
    if not t.isascii() and not _ODD.isdisjoint(t):
        return True
    low = t.lower()
    return _BRACKETED.search(low) is not None or ("dot" in low and _SPACED.search(low) is not None) or (any(x in low for x in _NUMBERS) and _SPELLED.search(low) is not None)


def find(t: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that deobfuscation adds."""
    base = base_spans(t)
    if not _disguised(t):
        return base, []
    norm, pieces = normalise(t)
    if norm == t:
        return base, []
    # base spans as runs without overlap: the first that ends behind a span's start is the only one it can meet first
    starts, stops = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if stops and a < stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    more = []
    for kind, lo, hi in base_spans(norm):
        a, b = _source(pieces, len(norm), lo, hi)
        k = bisect_right(stops, a)
        if k == len(starts) or b <= starts[k]:
            more.append((kind, a, b))
    return base, more


def mask(t: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [t[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, t[at:]])


SPAN = "struct<kind:string,start:bigint,stop:bigint,base:boolean>"


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", masked: bool = False) -> DataFrame:
    """Per row: key and spans (by kind as in KINDS, then start); masked adds masked_text, null where the text is."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            spans, texts = [], []
            for t in b.column(1).to_pylist():
                base, more = find(t) if t else ([], [])
                every = sorted([(KINDS.index(k), lo, hi, True) for k, lo, hi in base] + [(KINDS.index(k), lo, hi, False) for k, lo, hi in more])
                spans.append([{"kind": KINDS[k], "start": lo, "stop": hi, "base": x} for k, lo, hi, x in every])
                if masked:
                    texts.append(mask(t, [*base, *more]) if every else t)
            more_columns = [pa.array(texts, pa.string())] if masked else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, span), *more_columns], ["key", "spans", *["masked_text"] * masked])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, spans array<{SPAN}>" + ", masked_text string" * masked).withColumnRenamed("key", key)


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span masked in its text column; other columns as they are."""
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for t in b.column(at).to_pylist():
                base, more = find(t) if t else ([], [])
                clean.append(mask(t, [*base, *more]) if base or more else t)
            yield b.set_column(at, b.schema.field(at), pa.array(clean, pa.string()).cast(b.schema.field(at).type))

    return docs.mapInArrow(run, schema)
