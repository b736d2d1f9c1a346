"""Personal data, disguised or plain, as spans of the source text.

Transducers rewrite a text and keep an alignment to it: homoglyphs become the characters they imitate, digits of any
script ASCII digits, characters that aren't shown go, spelled digits become digits, and at/dot disguises become ``@`` and ``.``. Identifiers are detected in the text itself,
in the form with all edits composed, and in the forms with one kind of edit; spans of these are mapped back to source
characters and added where they overlap no span found before. All patterns run in time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import Batches, map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: from within the run the same rest would be tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DECIMALS = frozenset("0123456789")


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost, not overlapping: found from each ``@``."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[Span]:
    """Dotted quads whose parts are at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    """Digits with single blanks or hyphens between them: 13 to 19 of them that pass the Luhn check."""
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    """International numbers: 9 to 15 digits after a plus sign."""
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in DETECTORS.items()}


# Homoglyphs. Letters of other scripts that look like an ASCII letter, script by script.
_LOOKALIKES = dict(
    pair
    for foreign, ascii_ in (
        ("аеорсухіјѕԁһӏԛԝѵАВЕКМНОРСТУХІЈЅҮԚԜѴӀ", "aeopcyxijsdhlqwvABEKMHOPCTYXIJSYQWVI"),  # Cyrillic
        ("αορνικυχγητωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aopvikuxyntwcjABEZHIKMNOPTYXCJ"),  # Greek
        ("օոսհցզՕՏԼՍ", "onuhgqOSLU"),  # Armenian
        ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHYGZSLCPKB"),  # Cherokee
        ("ıɑɡɩʏᴄᴏᴠᴡᴢꜱƖ", "iagiYcovwzsl"),  # Latin beyond ASCII
    )
    for pair in zip(foreign, ascii_, strict=True)
)


def _plain(c: str) -> str | None:
    """What a character beyond ASCII stands for: the letter it looks like, its digit, the one ASCII character of its
    compatibility form, or nothing where it is not shown at all; None if it stands for itself."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    if unicodedata.category(c) == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form.isascii() and form.isprintable() and form != " " else None


class _Plain(dict):
    """Each character met and what it stands for, itself included."""

    def __missing__(self, c: str) -> str:
        found = c if c.isascii() else _plain(c)
        self[c] = c if found is None else found
        return self[c]


_PLAIN = _Plain()


def plain_form(text: str) -> tuple[str, list[Alignment]]:
    """The text with homoglyphs as the characters they imitate and without characters that aren't shown."""
    changed = {c: new for c in set(text) if not c.isascii() and (new := _PLAIN[c]) != c}
    if not changed:
        return text, []
    gone = [c for c, new in changed.items() if not new]
    plain = text.translate(str.maketrans({c: new for c, new in changed.items() if new}))
    if not gone:
        return plain, []
    hidden = re.compile(f"[{re.escape(''.join(gone))}]+")
    rewritten, alignment = rewrite(plain, [(m.start(), m.end(), "") for m in hidden.finditer(plain)])
    return rewritten, [alignment]


#: Spelled digits of four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_ONE_WORD = re.compile(_WORD, re.IGNORECASE)
# Four or more in a row, or fewer beside a digit or a disguised dot, else they are prose. The gaps between them go, a
# leading "plus" becomes a sign.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus\x20)?{_WORD}(?:[\x20,-]{{1,2}}{_WORD})*(?!\w)", re.IGNORECASE)
_LEAST_RUN = 4
_PLUS = re.compile(r"plus\x20", re.IGNORECASE)
_DIGIT_BEFORE = re.compile(r"[0-9][\x20().-]{1,2}\Z")
_DIGIT_AFTER = re.compile(r"[\x20().-]{1,2}[0-9]")

_AT = r"\x20?[\[({<]\x20?(?:at|@|arroba)\x20?[\])}>]\x20?|\x20(?:at|arroba)\x20"
_DOT = r"\x20?[\[({<]\x20?(?:dot|\.|punkt|point|punto)\x20?[\])}>]\x20?|\x20(?:dot|punkt|point|punto)\x20"
_NAME = r"[A-Za-z0-9_%+-]"
# Sought from the at-sign on: the part after it must have a dot, plain or disguised, so that "at" in prose stays.
_AT_SIGN = re.compile(rf"(?<={_NAME})(?:{_AT}|@)(?={_NAME}{{1,63}}(?:{_DOT}|\.){_NAME})", re.IGNORECASE)
#: A bare " at " is prose unless the name before it is one of parts and the last label after it can be a top-level domain, or
#: something else is disguised. Generic domains; country codes are any two letters.
_NAME_OF_PARTS = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[._+][A-Za-z0-9]+)*[._+][A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*\Z")
_TOP_LEVEL = frozenset(["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "dev", "app", "example", "test", "cloud", "online", "site", "store", "tech", "blog", "email"])
_DOT_SIGN = re.compile(rf"(?:{_DOT})(?={_NAME})", re.IGNORECASE)
_HOST_PART = re.compile(rf"{_NAME}{{1,63}}")
_DOT_BEFORE = re.compile(rf"(?:{_DOT})\Z", re.IGNORECASE)
# Dots between groups of digits, as in addresses of hosts.
_DIGIT_DOT = re.compile(rf"(?:{_DOT})(?=[0-9])", re.IGNORECASE)
_DOT_AFTER = re.compile(_DOT, re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|@|dot|\.|arroba|punkt|point|punto)\x20?[\])}>]")
_BARE_SIGNS = (" dot ", " punkt ", " point ", " punto ", " at ", " arroba ")


class _Marks(dict):
    """1: a spelled digit. 2: a word that may stand beside one, with a digit at an end or meaning a dot. 0: others."""

    def __missing__(self, word: str) -> int:
        return 2 if word[0] in "0123456789" or word[-1] in "0123456789" else 0


_MARKS = _Marks(dict.fromkeys(SPELLED, 1) | dict.fromkeys(("dot", "punkt", "point", "punto"), 2))
_TOKEN = re.compile(r"\w+")


def may_be_spelled(low: str) -> bool:
    """Two digit words in a row, or one beside a digit or a dot; a dot that is a bracketed sign has no word of its own."""
    marks = bytes(map(_MARKS.__getitem__, _TOKEN.findall(low)))
    return b"\1\1" in marks or b"\1\2" in marks or b"\2\1" in marks


def may_be_disguised(low: str) -> bool:
    """All that the patterns of at-signs and dots match has one of these."""
    return any(sign in low for sign in _BARE_SIGNS) or _BRACKETED.search(low) is not None


#: Where pieces of a rewritten text begin; for each, its source place and, if an edit made it, where that edit's source ends.
Alignment = tuple[list[int], list[tuple[int, int | None]]]


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Alignment]:
    """Apply edits (start, stop, new), ordered and apart. Each new character stands for the source of its whole edit."""
    pieces, at, source, size, done = [], [0], [(0, None)], 0, 0
    for start, stop, new in edits:
        pieces += text[done:start], new
        size += start - done
        at += range(size, size + len(new))
        source += [(start, stop)] * len(new)
        size += len(new)
        at.append(size)
        source.append((stop, None))
        done = stop
    pieces.append(text[done:])
    return "".join(pieces), (at, source)


def to_source(span: Span, alignment: Alignment) -> Span:
    """The source characters that a span of the result came from."""
    at, source = alignment
    k = bisect_right(at, span[0]) - 1
    start = source[k][0] if source[k][1] is not None else source[k][0] + span[0] - at[k]
    k = bisect_right(at, span[1] - 1) - 1
    stop = source[k][1] if source[k][1] is not None else source[k][0] + span[1] - at[k]
    return start, stop


def _adjoins(text: str, start: int, stop: int) -> bool:
    """Whether a digit or a disguised dot stands right before ``start`` or right after ``stop``."""
    before = text[max(0, start - 12) : start]
    return any((_DIGIT_BEFORE.search(before), _DIGIT_AFTER.match(text, stop), _DOT_BEFORE.search(before), _DOT_AFTER.match(text, stop)))


def spelled_edits(text: str, short: bool = False) -> list[tuple[int, int, str]]:
    """Runs of spelled digits; with ``short``, also those of fewer words that adjoin digits."""
    edits = []
    for m in _SPELLED_RUN.finditer(text):
        place = m.start()
        if sum(1 for _ in islice(_ONE_WORD.finditer(text, place, m.end()), _LEAST_RUN)) < _LEAST_RUN and not (short and _adjoins(text, place, m.end())):
            continue
        if plus := _PLUS.match(text, place):
            edits.append((place, plus.end(), "+"))
            place = plus.end()
        for w in _ONE_WORD.finditer(text, place, m.end()):
            if w.start() > place:
                edits.append((place, w.start(), ""))
            edits.append((w.start(), w.end(), SPELLED[w[0].casefold()]))
            place = w.end()
    return edits


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs of disguised addresses: the at-sign, the dots after it, and disguised dots in the 255 characters before; and
    disguised dots between digits."""
    edits: list[tuple[int, int, str]] = []
    for m in _AT_SIGN.finditer(text):
        floor = max(edits[-1][1] if edits else 0, m.start() - 255)
        before = _last_name(text, floor, m.start())
        found = [(d.start(), d.end(), ".") for d in _DOT_SIGN.finditer(text, before, m.start())]
        bare = m[0].casefold() == " at "
        sure = not bare or bool(found)
        if m[0] != "@":
            found.append((m.start(), m.end(), "@"))
        place = label = m.end()
        while part := _HOST_PART.match(text, place):
            place, label = part.end(), part.start()
            if dot := _DOT_SIGN.match(text, place):
                found.append((dot.start(), dot.end(), "."))
                place, sure = dot.end(), True
            elif text[place : place + 1] == "." and _HOST_PART.match(text, place + 1):
                place += 1
            else:
                break
        last = text[label:place].casefold()
        if sure or _NAME_OF_PARTS.match(text[before : m.start()]) and (last in _TOP_LEVEL or len(last) == 2 and last.isalpha()):
            edits += found
    edits += [(d.start(), d.end(), ".") for d in _DIGIT_DOT.finditer(text) if text[d.start() - 1 : d.start()] in _DECIMALS]
    kept: list[tuple[int, int, str]] = []
    for edit in sorted(set(edits)):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


def _last_name(text: str, floor: int, stop: int) -> int:
    """Where the name before an at-sign begins: names joined by plain or disguised dots, looked for backwards."""
    start = stop
    while True:
        begin = start
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin == start:
            return start
        start = begin
        dot = _DOT_BEFORE.search(text, max(floor, start - 12), start)
        if dot is None:
            return start
        start = dot.start()


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers that show only in a rewritten form, as source spans. They overlap no span found before, unless they
    contain base spans of their kind, of which a disguise hides a part."""
    taken = sorted(span for spans in base.values() for span in spans)
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    plain, shown = plain_form(text)
    forms: list[tuple[str, list[Alignment]]] = []
    low = plain.casefold()
    spelled = disguised = None
    if may_be_spelled(low) and (edits := spelled_edits(plain, short=True)):
        digits, alignment = rewrite(plain, edits)
        spelled = (digits, [alignment, *shown])
    if may_be_disguised(low):
        form, before = spelled or (plain, shown)
        if edits := address_edits(form):
            rewritten, alignment = rewrite(form, edits)
            disguised = (rewritten, [alignment, *before])
    # The form with all edits comes first. What only shows with fewer of them is added after it.
    if disguised:
        forms.append(disguised)
    if spelled:
        forms.append(spelled)
        if edits := spelled_edits(plain):
            digits, alignment = rewrite(plain, edits)
            forms.append((digits, [alignment, *shown]))
        if disguised and (edits := address_edits(plain)):
            rewritten, alignment = rewrite(plain, edits)
            forms.append((rewritten, [alignment, *shown]))
    if plain is not text:
        forms.append((plain, shown))
    for form, alignments in forms:
        for kind, spans in detect(form).items():
            for span in spans:
                for alignment in alignments:
                    span = to_source(span, alignment)
                start, stop = span
                first = bisect_right(taken, start, key=lambda x: x[1])
                last = bisect_left(taken, stop, key=lambda x: x[0])
                hidden = taken[first:last]
                if all(start <= a and b <= stop and (a, b) != span and (a, b) in base[kind] for a, b in hidden):
                    taken[first:last] = [span]
                    added[kind].append(span)
    return {kind: sorted(spans) for kind, spans in added.items()}


def _scan(batches: Batches) -> Batches:
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("added", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = detect(text or "")
            added = added_spans(text or "", base)
            rows.append(
                [
                    {"kind": kind, "start": start, "stop": stop, "added": new}
                    for kind in KINDS
                    for start, stop, new in sorted([(*s, False) for s in base[kind]] + [(*s, True) for s in added[kind]])
                ]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, entry)], names=["key", "spans"])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every row: ``key``, ``spans`` of kind, start, stop (source code points, end exclusive)
    and whether only a rewritten form showed them.

    Null text counts as empty; nulls and repeats of ``key`` keep a row each; texts of any length are scanned whole, in time
    linear in it; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    out = f"key {kind}, spans array<struct<kind:string,start:int,stop:int,added:boolean>>"
    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), _scan, out).withColumnRenamed("key", key)


def span_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, for every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [count_kind(base, kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
