"""Problem 3: visually identical text with different characters, brought to one form.

Two forms of a text:

* ``display`` - what a reader sees, in ordinary characters: compatibility forms of letters, digits, marks and
  ligatures replaced, accents composed, every kind of space mapped to the plain one, hyphens to the plain one,
  default-ignorable characters removed, look-alike letters of another alphabet folded inside Latin words.
  Superscripts, degree signs, fractions, Greek symbols, formulae, Devanagari and joiners inside Indic words stay.
* ``key`` - for comparison: NFKC, full case folding and single spaces on top of ``display``.

A field is a candidate where its comparison key - compatibility form, composed, case-folded, white space mapped,
ignorables removed, look-alikes folded - differs from the text with nothing but plain capitals and blanks evened out.
Since symbols in their own right (superscripts, fractions, ligatures of other languages) differ there as well, an
exact check follows: the candidate is a case where ``display`` changes it. Work is done once per distinct value of an Arrow batch
(dictionary encoding), so repeated values cost nothing and no shuffle is needed.

Cases: null stays null; empty and plain ASCII texts come back as they are; both forms are idempotent.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.runtime import table

#: Hyphens that stand for the plain one; dashes and the minus sign are marks of their own.
HYPHENS = "‐‑﹣－"
#: Default-ignorable ranges (Unicode property), as fixed values; joiners are handled apart.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Look-alikes of Latin letters, as fixed values.
CYRILLIC = dict(zip("асеорхуѕіјһԁԛԝѵӏАВЕКМНОРСТХУЅІЈ", "aceopxysijhdqwvlABEKMHOPCTXYSIJ"))
GREEK = dict(zip("οιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oiABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օոսհցզՕՍՏԼ", "onuhgqOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHGZbRWSVSLCPKdB"))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"))
#: Cyrillic letters that look like Latin ones at a glance only, and letters of phonetic script: folded only in words
#: with two plain Latin letters or more.
CYRILLIC_WEAK = dict(zip("кгпитм", "krnutm"))
PHONETIC = dict(zip("ɑɡ", "ag"))
#: Greek letters that also serve as symbols beside Latin ones: folded only in longer Latin words.
GREEK_WEAK = dict(zip("νκυχ", "vkux"))

#: Compatibility tags whose characters stand for ordinary ones.
_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<small>", "<vertical>")
#: Compatibility characters that are symbols in their own right.
_SYMBOLS = frozenset("µ…‥․‖″‴⁗∬∭∯∰℡№℀℁℃℅℆℉₨ϐϑϒϕϖϰϱϲϴϵΩ")


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        if unicodedata.category(c) in ("Cn", "Co", "Cs"):
            continue
        if unicodedata.category(c) == "Zs":
            out[o] = " "
            continue
        d = unicodedata.decomposition(c)
        if not d or c in _SYMBOLS:
            continue
        tag = d.split()[0]
        if tag[0] == "<":
            if tag in _TAGS:
                n = unicodedata.normalize("NFKC", c)
                if not n.startswith(" ") and not "Ͱ" <= n[0] <= "Ͽ" and (unicodedata.category(c) != "Sm" or tag in ("<wide>", "<narrow>", "<small>")):
                    out[o] = n
        elif " " not in d and o < 0x3000 and unicodedata.normalize("NFC", c) != c and "a" <= unicodedata.normalize("NFC", c)[0].lower() <= "ÿ":
            out[o] = unicodedata.normalize("NFC", c)
    out |= {ord(c): "-" for c in HYPHENS}
    for lo, hi in IGNORABLE:
        out |= dict.fromkeys(range(lo, hi + 1), "")
    return out


_MAP = _table()


def _class(points: list[int]) -> str:
    """A character class of the points, as ranges."""
    out, points = [], sorted(points)
    start = last = points[0]
    for p in [*points[1:], None]:
        if p is not None and p == last + 1:
            last = p
            continue
        out.append(f"\\U{start:08x}-\\U{last:08x}")
        start = last = p
    return "[" + "".join(out) + "]"


_MAPPED = re.compile(_class(list(_MAP)))
_JOINER = re.compile("[‌‍]")
_INDIC = re.compile("(?<=[ऀ-෿])[‌‍]+(?=[ऀ-෿])")
#: A letter and the marks on it; Indic scripts keep theirs apart (their composed forms are excluded from composition).
_MARKS = re.compile("[^\\W\\d_ऀ-෿][\u0300-\u036f\u0483-\u0487\u0653-\u0655\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20dc\u3099\u309a]+")
_FOREIGN = ((CYRILLIC, "Ѐ", "ԯ"), (ARMENIAN, "\u0531", "\u0587"), (CHEROKEE, "\u13a0", "\u13fd"), (LISU, "\ua4d0", "\ua4f7"))
_FOLDED = "".join([*CYRILLIC, *CYRILLIC_WEAK, *ARMENIAN, *CHEROKEE, *LISU, *PHONETIC, *GREEK, *GREEK_WEAK])
_OTHER = re.compile(f"[{_FOLDED}]")
_WORDS = re.compile(r"[^\W\d_]+")
_MATH = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\$[^$\n]+\$", re.S)
_CYR = re.compile("[Ѐ-ԯ\u0531-\u0587\u13a0-\u13fd\ua4d0-\ua4f7]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_PLAIN_LATIN = re.compile("[A-Za-z]")


#: Every character that can make display() change a text: without one of them the text comes back at once.
_ODD = frozenset([*map(chr, _MAP), "‌", "‍", *_FOLDED, *(chr(o) for lo, hi in ((0x300, 0x36F), (0x483, 0x487), (0x653, 0x655), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20DC), (0x3099, 0x309A)) for o in range(lo, hi + 1))])


def _fold_word(w: str, latin_text: bool, math: bool) -> str:
    latin = len(_LATIN.findall(w))
    if _CYR.search(w):
        for table_, lo, hi in _FOREIGN:
            own = [c for c in w if lo <= c <= hi]
            if own and all(c in table_ for c in own) and (latin or latin_text or math):
                w = "".join(table_.get(c, c) for c in w)
                latin = len(_LATIN.findall(w))
            elif own and table_ is CYRILLIC and latin >= 2 and all(c in CYRILLIC or c in CYRILLIC_WEAK for c in own):
                w = "".join(CYRILLIC.get(c) or CYRILLIC_WEAK.get(c, c) for c in w)
    if math:
        return w
    if not PHONETIC.keys().isdisjoint(w) and len(_PLAIN_LATIN.findall(w)) >= 2:
        w = "".join(PHONETIC.get(c, c) for c in w)
    greek = [c for c in w if "Ͱ" <= c <= "Ͽ"]
    if greek:
        strong = all(c in GREEK for c in greek)
        if strong and latin and len(w) > 1:
            return "".join(GREEK.get(c, c) for c in w)
        if strong and not latin and latin_text and (len(w) > 1 or w in "ΑΙ"):
            return "".join(GREEK.get(c, c) for c in w)
        if latin >= 2 and all(c in GREEK or c in GREEK_WEAK for c in greek):
            return "".join(GREEK.get(c) or GREEK_WEAK.get(c, c) for c in w)
    return w


def _fold(text: str) -> str:
    latin = len(_LATIN.findall(text))
    latin_text = latin > 2 * (len(_CYR.findall(text)) + sum(c in GREEK for c in text))
    out, at = [], 0
    for m in _MATH.finditer(text):
        out.append(_WORDS.sub(lambda x: _fold_word(x[0], latin_text, False), text[at : m.start()]))
        out.append(_WORDS.sub(lambda x: _fold_word(x[0], latin_text, True), m[0]))
        at = m.end()
    out.append(_WORDS.sub(lambda x: _fold_word(x[0], latin_text, False), text[at:]))
    return "".join(out)


def display(text: str) -> str:
    """The text in ordinary characters; unchanged where nothing stands for anything else."""
    while not (text.isascii() or _ODD.isdisjoint(text)) and (t := _display_once(text)) != text:
        text = t  # a folded letter can make its word a Latin one, or take a mark
    return text


def _display_once(text: str) -> str:
    if _JOINER.search(text):
        kept = [m.span() for m in _INDIC.finditer(text)]
        text = _JOINER.sub(lambda m: m[0] if any(a <= m.start() < b for a, b in kept) else "", text)
    if _MAPPED.search(text):
        text = text.translate(_MAP)
    if _OTHER.search(text):
        text = _fold(text)
    if _MARKS.search(text):
        text = _MARKS.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
    return text


def _key_once(text: str) -> str:
    t = display(text)
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def key(text: str) -> str:
    """The comparison key: compatibility form, full case folding, single spaces."""
    t = _key_once(text)
    while not t.isascii() and (again := _key_once(t)) != t:  # folding case can show a look-alike
        t = again
    return t


_CAPITALS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


def is_case(text: str) -> bool:
    """Whether the text holds a stand-in: its comparison key says more than plain capitals and blanks do, and the
    exact check agrees."""
    if text.isascii() or _ODD.isdisjoint(text):
        return False
    return key(text) != _BLANKS.sub(" ", text.translate(_CAPITALS)).strip(" ") and display(text) != text


def per_distinct(column: pa.Array, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """Apply f once to each distinct value of a column; null stays null."""
    enc = column.dictionary_encode()
    values = pa.array([f(v) for v in enc.dictionary.to_pylist()], kind)
    return values.take(enc.indices)


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name in ("stem", "explanation"):
            col = b.column(b.schema.get_field_index(name))
            hit = per_distinct(col, is_case, pa.bool_())
            ids = b.column(0).filter(hit.fill_null(False))
            yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids), pa.string())], names=["id", "field_name"])


def cases(questions: DataFrame) -> DataFrame:
    """(id, field_name) of every field that holds a stand-in character. ASCII fields never leave the JVM."""
    odd = r"[^\x00-\x7f]"
    q = questions.where("id is not null").select("id", *(F.when(F.col(c).rlike(odd), F.col(c)).alias(c) for c in ("stem", "explanation"))).where("stem is not null or explanation is not null")
    return q.mapInArrow(_cases, "id string, field_name string").distinct()


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [b.column(0)]
        for i in (1, 2):
            out += [per_distinct(b.column(i), display, pa.string()), per_distinct(b.column(i), key, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["id", "stem", "stem_key", "explanation", "explanation_key"])


def normalised(questions: DataFrame) -> DataFrame:
    """Every distinct record's stem and explanation in display form and as comparison keys. Repeats go before the forms
    are made, so that only the two texts move."""
    return questions.select("id", "stem", "explanation").distinct().mapInArrow(_normal, "id string, stem string, stem_key string, explanation string, explanation_key string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(table(spark, sf_dir, "question").select("id", "stem", "explanation"))


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "question"))
