"""Problem 5: noise in text from scanned pages.

Structure first: running headers and footers (title-like lines whose parts recur over the corpus, or name the
record's own chapter), page numbers, letter-spaced furniture, words hyphenated across lines, also around furniture.
Then words: a noisy channel. A word that the confusions below turn into a much more frequent word is a suspect;
its candidates get channel probability times corpus n-gram likelihood, and each line is decoded by Viterbi over the
candidate words.

Corpus counts (words, word pairs, title parts, hyphenated compounds) come from one pre-aggregated pass over all
texts and are written once. Title parts and compounds are looked up by a join, with what the lines of each field ask
for, so that the same bar holds at every size. Suspect words join the words of the repaired fields, of which a bitmap
of ``BITS`` hash values lets through the suspects and few others; each field gets all its suspects before it is decoded.
Word-pair counts join only the suspects' own contexts, by hash.

A word's characters that are no letters are all undone, letters in up to two places. A string of over ``WORD``
characters is no word of a language and is left alone.

Cases: null fields stay null and have no noise; empty texts stay empty; line breaks alone are no noise; ids that
repeat give each kind once; a field of nothing but furniture becomes empty.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.lookalike import display
from quillmark.runtime import table, written

#: Misreadings, wrong to right, with the channel's probability, as fixed values.
CONFUSIONS = {
    "c": (("e", 0.01),), "f": (("t", 0.01),), "b": (("h", 0.01),), "rn": (("m", 0.01),), "cl": (("d", 0.01),), "ii": (("u", 0.01),), "vv": (("w", 0.01),), "li": (("h", 0.005),),
    "0": (("o", 0.02),), "1": (("l", 0.02), ("i", 0.01)), "!": (("i", 0.02), ("l", 0.005)), "$": (("s", 0.02),), "9": (("g", 0.02),), "5": (("s", 0.02),), "8": (("b", 0.02),),
    "6": (("b", 0.01), ("g", 0.005)), "3": (("e", 0.01),), "4": (("a", 0.01),), "7": (("t", 0.01),), "2": (("z", 0.01),), "|": (("l", 0.02), ("i", 0.01)), "@": (("a", 0.02),), "€": (("e", 0.01),),
    "(": (("c", 0.005),), "m": (("rn", 0.002),), "d": (("cl", 0.002),), "w": (("vv", 0.001),), "h": (("b", 0.002), ("li", 0.001)), "e": (("c", 0.002),), "t": (("f", 0.002),), "u": (("ii", 0.001), ("n", 0.001)), "n": (("u", 0.001), ("ri", 0.001)), "i": (("l", 0.002),), "l": (("i", 0.002), ("t", 0.001)),
}
#: A word is left alone unless a candidate is this many times as frequent.
RATIO = 20
#: Occurrences a right word needs; records in which a title part must recur.
KNOWN, RECURS = 4, 2
#: Characters of the longest string taken for a word.
WORD = 64
#: Size of the bitmap of suspect words; where it is too small, more words are joined in vain.
BITS = 1 << 24

#: Confusions of one character that is no letter.
_ODD = frozenset(c for c in CONFUSIONS if len(c) == 1 and not c.isalpha())

_NUMBER = re.compile(r"(?<![^\W_])\d+(?:[.,:/]\d+)*(?![^\W_])")
_FORMULA = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]", re.S)
_DOLLARS = re.compile(r"(?<!\S)(\$\$?)(?=[^\s$])[^$\n]*(?<=\S)\1(?![^\W_]|\$)")
_EDGE = ".,;:?()[]\"'“”‘’।"


def _lm(text: str) -> list[str]:
    """The language model's words of a text: lower case, numbers and formulae as classes."""
    t = _FORMULA.sub(" \x01 ", text) if "\\" in text else text
    t = _DOLLARS.sub(" \x01 ", t) if "$" in t else t
    return _NUMBER.sub("9", t.lower()).split()


def trimmed(word: str) -> str:
    w = word.strip(_EDGE)
    return w.rstrip("!") or w


def pair_key(a: str, b: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{a}\x02{b}") - (1 << 63)


_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_PAGE_NO = r"\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?"
_PAGE = re.compile(rf"^[\s\[(\-–—~*|]*(?:(?:page|pg|pp?|पृष्ठ)\b\s*[.:]?\s*)?{_PAGE_NO}[\s\])\-–—~*|]*$", re.I)
_BARE = re.compile(r"^\s*\d{1,4}\s*$")
_AT_ENDS = re.compile(rf"^\s*[\[(\-–—]*{_PAGE_NO}[\])\-–—]*\s*[|:·\-–—]?\s+(?=\D)|(?<=\D)\s+[|:·\-–—]?\s*[\[(\-–—]*{_PAGE_NO}[\])\-–—]*\s*$")
_PARTS = re.compile(r"\s*[|:·]\s*|\s+[-–—]\s+")
_DECOR = " \t~*=_-–—"
_ALPHA = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def unspaced(line: str) -> tuple[str, bool]:
    """A line with letter-spaced words closed up, and whether it was one."""
    if not _SPACED.search(line):
        return line, False
    tokens = line.split()
    if len(tokens) < 6 or sum(len(t) == 1 for t in tokens) < 0.7 * len(tokens):
        return line, False
    return re.sub(r"\s*\|\s*", " | ", " ".join(w.replace(" ", "") for w in re.split(r"\s{2,}", line.strip()))), True


def title_parts(line: str) -> tuple[list[str], bool, bool]:
    """(parts, numbered, spaced) of a line that looks like a running title; no parts where it does not."""
    if not line:
        return [], False, False
    t, spaced = unspaced(line)
    if t.rstrip()[-1:] in (".", "?", ",", ";", "।") or "\\" in t:
        return [], False, False
    core = _AT_ENDS.sub("", t).strip(_DECOR)
    numbered = any(c.isdigit() for c in t) and not any(c.isdigit() for c in core)
    words = _ALPHA.findall(core)
    if len(words) < 2 or any(c.isdigit() for c in core):
        return [], False, False
    if any(len(w) > 3 and not w[0].isupper() for w in words) or not words[0][0].isupper():
        return [], False, False
    return [p.casefold() for p in (x.strip(_DECOR) for x in _PARTS.split(core)) if p], numbered, spaced


_SPLIT = re.compile(r"(?:(?<=\s)|^|(?<=[(\[\"“'*]))([^\W\d_]+(?:['’][^\W\d_]+)?)( ?[-=¬] ?)$")
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]{2,}(?:-[^\W\d_]{2,})+(?![\w-])")


def repair_lines(text: str, titles, compounds, chapter: str | None = None) -> tuple[str, set[str]]:
    """The text without furniture and line-break hyphens, lines joined to paragraphs; and the kinds found."""
    kinds: set[str] = set()
    if "\n" not in text:
        return text, kinds
    own = chapter.casefold() if chapter else None
    kept: list[str] = []
    lines = text.split("\n")
    last = len(lines) - 1
    for n, line in enumerate(lines):
        s = line.strip()
        if not s:
            kept.append("")
            continue
        if s[-1].isdigit() or s[-1] in "])-–—~*|":
            if _PAGE.match(s) and not (n == last and _BARE.match(s) and kept and kept[-1].rstrip()[-1:] not in (".", "?", "!", "।", "")):
                kinds.add("page_number")
                continue
        if s[0].isupper() or s[0].isdigit() or s[0] in "~*=-[(|":
            parts, numbered, spaced = title_parts(s)
            if parts and (spaced or any(p in titles or p == own for p in parts)):
                kinds.add("header")
                if numbered:
                    kinds.add("page_number")
                continue
        kept.append(line)
    out: list[str] = []
    for line in kept:
        s = line.strip()
        if not s:
            if out and out[-1] != "":
                out.append("")
            continue
        if out and out[-1]:
            before = out[-1]
            m = _SPLIT.search(before) if before[-1] in "-=¬ " or before.endswith("\xad") else None
            right = _ALPHA.match(s)
            if m and right and (right[0][0].islower() or m[1].isupper()) and before.count("\\(") <= before.count("\\)"):
                left, mark = m[1], m[2]
                if mark == "-" and f"{left}-{right[0]}".lower() in compounds:
                    out[-1] = before.rstrip() + s
                else:
                    kinds.add("hyphen")
                    out[-1] = before[: m.start(1)] + left + s
                continue
            if before.rstrip()[-1:] not in (".", "?", "!", "।", ":"):
                out[-1] = before.rstrip() + " " + s
                continue
        out.append(line.rstrip() if line[:1] != " " else s)
    return "\n".join(x.rstrip() for x in out).strip("\n"), kinds


def _end(text: str) -> str:
    """As much of a paragraph's end as a word split at its end can take."""
    return " ".join(text.rsplit(" ", 3)[-3:])


def asked(text: str, chapter: str | None = None) -> tuple[set[str], set[str]]:
    """Title parts and compounds that repair_lines may look up: at least those it does, whatever is found."""
    titles: set[str] = set()
    compounds: set[str] = set()
    own = chapter.casefold() if chapter else None
    ends: set[str] = set()  # what the paragraph so far may end with
    for line in text.split("\n") if "\n" in text else ():
        s = line.strip()
        if not s:
            ends = set()
            continue
        may_go = bool((s[-1].isdigit() or s[-1] in "])-–—~*|") and _PAGE.match(s))
        if s[0].isupper() or s[0].isdigit() or s[0] in "~*=-[(|":
            parts, _, spaced = title_parts(s)
            if parts and (spaced or own in parts):
                continue
            titles.update(parts)
            may_go = may_go or bool(parts)
        after = set(ends) if may_go else set()
        right = _ALPHA.match(s)
        for e in ends:
            m = _SPLIT.search(e) if e[-1] in "-=¬ " else None
            if m and right:
                if m[2] == "-":
                    compounds.add(f"{m[1]}-{right[0]}".lower())
                    after.add(_end(e.rstrip() + s))
                after.add(_end(e[: m.start(1)] + m[1] + s))
            after.add(_end(e.rstrip() + " " + s))
        after.add(_end(line.rstrip() if line[:1] != " " else s))
        ends = after
    return titles, compounds


def _once(w: str) -> dict[str, float]:
    """What one misread place may have been."""
    out: dict[str, float] = {}
    for i in range(len(w)):
        for n in (1, 2):
            for right, p in CONFUSIONS.get(w[i : i + n], ()) if i + n <= len(w) else ():
                v = w[:i] + right + w[i + n :]
                out[v] = max(out.get(v, 0.0), p)
    return out


def candidates(word: str, least: float = 1e-12) -> dict[str, float]:
    """Words that misreading may have turned into this one, with the channel's probability where it is not under
    ``least``: up to two places anywhere, or every character that is no letter and up to two places more."""
    if len(word) > WORD:
        return {}
    one = _once(word)
    out = dict(one)
    for w, p in one.items():
        for v, q in _once(w).items():
            if v != word and p * q >= least and not (len(v) == len(word) and sorted(v) == sorted(word)):  # a swap is a slip of the hand
                out[v] = max(out.get(v, 0.0), p * q)
    odd = [i for i, c in enumerate(word) if c in _ODD]
    if len(odd) > 2:
        whole = {"": 1.0}
        for c in word:
            # a mark that is no letter was one
            ways = CONFUSIONS[c] if c in _ODD else ((c, 1.0),)
            whole = {w + right: p * q for w, p in whole.items() for right, q in ways if p * q >= least}
        for w, p in whole.items():
            out[w] = max(out.get(w, 0.0), p)
            for v, q in _once(w).items():
                if p * q >= least:
                    out[v] = max(out.get(v, 0.0), p * q)
    return out


_STATS = "kind int, word string, key bigint, n bigint"


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (1), word pairs (2), title parts (3) and hyphenated compounds (4), combined per task."""
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    parts: Counter[str] = Counter()
    compounds: Counter[str] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        w: Counter[str] = Counter()
        of = {}
        for raw, n in words.items():
            t = of[raw] = trimmed(raw)
            if t:
                w[t] += n
        p: Counter[int] = Counter()
        for (a, b), n in pairs.items():
            x, y = of.get(a) or trimmed(a), of.get(b) or trimmed(b)
            if x and y:
                p[pair_key(x, y)] += n
        for kind, c in ((1, w), (3, parts), (4, compounds)):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.nulls(len(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["kind", "word", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(p), pa.int32()), pa.nulls(len(p), pa.string()), pa.array(list(p), pa.int64()), pa.array(list(p.values()), pa.int64())], names=["kind", "word", "key", "n"])
        for c in (words, pairs, parts, compounds):
            c.clear()

    for b in batches:
        for col in b.columns:
            for text in col.to_pylist():
                if not text:
                    continue
                text = display(text)
                t = _lm(text)
                words.update(t)
                pairs.update(zip(t, t[1:]))
                if "-" in text:
                    compounds.update(x.lower() for x in _COMPOUND.findall(text))
                if "\n" in text:
                    for line in text.split("\n"):
                        s = line.strip()
                        if s and (s[0].isupper() or s[0].isdigit() or s[0] in "~*=-[(|"):
                            parts.update(set(title_parts(s)[0]))
        if len(pairs) > 1_000_000:
            yield from flush()
    yield from flush()


def census(questions: DataFrame) -> DataFrame:
    got = questions.select("stem", "explanation").mapInArrow(_census, _STATS)
    return written(got.groupBy("kind", "word", "key").agg(F.sum("n").alias("n")), "p5-counts")


def _suspects(most: int):
    """Words to their candidates; most: occurrences of the most frequent word, which bound how improbable a misreading
    can be that still passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(w) >= 2 and any("a" <= c <= "z" for c in w):
                    out += [(w, n, v, math.log(p)) for v, p in candidates(w, 0.1 * n / most).items() if v.isalpha() or "-" in v]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.float64()))], names=["wrong", "n_wrong", "word", "logp"])

    return run


def suspects(counts: DataFrame) -> DataFrame:
    """(wrong, n_wrong, right, n_right, logp): words that a much more frequent word explains."""
    words = counts.where("kind = 1").select("word", "n")
    most = words.agg(F.max("n")).first()[0] or 1
    ask = words.where(F.col("n") * RATIO <= most).mapInArrow(_suspects(most), "wrong string, n_wrong bigint, word string, logp double")
    known = words.where(F.col("n") >= KNOWN).select("word", F.col("n").alias("n_right"))
    # the more improbable the misreading, the larger the distance in frequency it takes
    least = F.greatest(F.lit(float(RATIO)), F.lit(0.1) / F.exp("logp"))
    return ask.join(known, "word").where(F.col("n_right") >= least * F.col("n_wrong")).select("wrong", "n_wrong", F.col("word").alias("right"), "n_right", "logp")


_TOKENS = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\S+", re.S)


def _bitmap(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size, dtype=bool)
        for b in batches:
            on[[xxhash.xxh3_64_intdigest(w) % size for w in b.column(0).to_pylist()]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on).tobytes()], pa.binary())], names=["bits"])

    return run


class Maybe:
    """Words that may be suspects: all that are, and those that share a hash value with one."""

    def __init__(self, bits: bytes, size: int) -> None:
        self.bits, self.size, self.seen = bits, size, {}

    def __contains__(self, word: str) -> bool:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            h = xxhash.xxh3_64_intdigest(word) % self.size
            got = self.seen[word] = bool(self.bits[h >> 3] & (128 >> (h & 7)))
        return got


def _words(line: str, low: str) -> tuple[list[tuple[int, int]], list[str]]:
    """The tokens of a line and their words; formulae and numbers as classes."""
    spans = [(m.start(), m.end()) for m in _TOKENS.finditer(line)]
    return spans, ["\x01" if low[a : a + 1] == "\\" else trimmed(_NUMBER.sub("9", low[a:e])) for a, e in spans]


def suspect_words(text: str, maybe) -> set[str]:
    """The words by which lattice() may find suspects."""
    out: set[str] = set()
    for line in text.split("\n"):
        low = line.lower()
        if some := {t for w in low.split() if (t := trimmed(w)) in maybe}:
            out |= some
            out.update(w for w in _words(line, low)[1] if w in maybe)
    return out


def lattice(text: str, known: dict[str, list]) -> list[dict]:
    """For each line with suspects: tokens around them and the candidates of each suspect."""
    out = []
    at = 0
    for line in text.split("\n"):
        low = line.lower()
        if any(trimmed(w) in known for w in low.split()):
            spans, words = _words(line, low)
            hits = [i for i, w in enumerate(words) if w in known]
            if hits:
                out.append({"at": at, "spans": spans, "words": words, "hits": hits, "options": [known[words[i]] for i in hits]})
        at += len(line) + 1
    return out


def lattice_keys(lines: list[dict]) -> list[int]:
    """Word pairs whose counts the decoding needs."""
    need: set[int] = set()
    for ln in lines:
        w = ln["words"]
        options = dict(zip(ln["hits"], ln["options"]))
        forms = lambda i: [w[i], *(o[0] for o in options.get(i, ()))]
        for i in ln["hits"]:
            for j in (i - 1, i):
                if 0 <= j and j + 1 < len(w):
                    need.update(pair_key(a, b) for a in forms(j) for b in forms(j + 1) if a and b)
    return sorted(need)


def decode(lines: list[dict], pairs: dict[int, int]) -> list[tuple[int, int, str]]:
    """Viterbi over the candidate words of each line: (start, end, right word) of every changed token."""
    out = []
    for ln in lines:
        w = ln["words"]
        options = dict(zip(ln["hits"], ln["options"]))

        def forms(i: int) -> list[tuple[str, float, float]]:
            """(word, log channel, occurrences)"""
            if i not in options:
                return [(w[i], 0.0, 0.0)]
            most = max(o[1] for o in options[i])
            n = max(0.0, options[i][0][3] - 0.05 * most)  # the share that misreading itself explains
            return [(w[i], math.log(0.9), n), *((o[0], o[2], float(o[1])) for o in options[i])]

        def step(a: tuple[str, float, float], b: tuple[str, float, float], own: str) -> float:
            """log P(b | a), interpolated with the single word; the noisy form itself has no clean pairs."""
            n = pairs.get(pair_key(a[0], b[0]), 0)
            if b[2] == 0.0 and b[0] == own:
                n = 0
            return math.log((n + 0.05 * b[2] / 1000 + 1e-4) / (a[2] + 10.0))

        lo, hi = max(0, ln["hits"][0] - 1), min(len(w) - 1, ln["hits"][-1] + 1)
        layer = [(0.0, [f]) for f in forms(lo)]
        if lo in options:
            layer = [(f[1] + math.log((f[2] + 0.1) / 1e4), [f]) for f in forms(lo)]
        for i in range(lo + 1, hi + 1):
            nxt = []
            for f in forms(i):
                best = max(((s + step(path[-1], f, w[i] if i in options else ""), path) for s, path in layer), key=lambda x: x[0])
                nxt.append((best[0] + f[1], [*best[1], f]))
            layer = nxt
        path = max(layer, key=lambda x: x[0])[1]
        for i, f in enumerate(path, lo):
            if i in options and f[0] != w[i]:
                a, e = ln["spans"][i]
                out.append((ln["at"] + a, ln["at"] + e, f[0]))
    return out


def replaced(text: str, changes: list[tuple[int, int, str]]) -> str:
    """The text with each changed token's core replaced, its case and outer marks kept."""
    for a, e, right in sorted(changes, reverse=True):
        token = text[a:e]
        core = trimmed(token)
        k = token.find(core)
        new = right.upper() if core.isupper() and len(core) > 1 and core.isalpha() else right[0].upper() + right[1:] if core[:1].isupper() else right
        text = text[:a] + token[:k] + new + token[k + len(core) :] + text[e:]
    return text


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to (id, field_name, h, kind, word): the title parts (3) and compounds (4) each field asks for."""
    for b in batches:
        out = []
        for i, name, h, chapter, text in zip(*(c.to_pylist() for c in b.columns)):
            titles, compounds = asked(display(text), chapter)
            out += [(i, name, h, k, w) for k, ws in ((3, titles), (4, compounds)) for w in ws]
        cols = list(zip(*out)) or [()] * 5
        kind = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind)], names=["id", "field_name", "h", "kind", "word"])


def _fields(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, field_name, chapter, text, titles, compounds): every field with those of its title parts and compounds
    that recur in the corpus. A field of one line has none, and does not move."""
    q = questions.where("id is not null").select("id", F.col("path.chapter").alias("chapter"), F.expr("stack(2, 'stem', stem, 'explanation', explanation) as (field_name, text)"))
    fields = q.where("text is not null").select("id", "field_name", F.xxhash64("chapter", "text").alias("h"), "chapter", "text")
    lined = F.contains("text", F.lit("\n"))
    asks = fields.where(lined).mapInArrow(_asks, "id string, field_name string, h bigint, kind int, word string")
    recur = counts.where(f"kind in (3, 4) and n >= {RECURS}").select("kind", "word")
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("word")))
    got = asks.join(recur, ["kind", "word"]).groupBy("id", "field_name", "h").agg(of(3).alias("titles"), of(4).alias("compounds"))
    none = F.lit(None).cast("array<string>")
    return fields.where(lined).join(got, ["id", "field_name", "h"], "left").unionByName(fields.where(~lined).select("*", none.alias("titles"), none.alias("compounds"))).drop("h")


def _first(shared, size: int):
    """Fields to (id, field_name, text, kinds, maybe): structure repaired, with the words that may be suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, every = shared.value
        maybe = Maybe(bits, size)
        for b in batches:
            out = []
            for i, name, chapter, raw, titles, compounds in zip(*(c.to_pylist() for c in b.columns)):
                text, kinds = repair_lines(display(raw), titles or (), compounds or (), chapter)
                words = sorted(suspect_words(text, maybe))
                if kinds or words or every:
                    out.append((i, name, text if words or every else None, sorted(kinds), words or None))
            cols = list(zip(*out)) or [()] * 5
            kind = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind)], names=["id", "field_name", "text", "kinds", "maybe"])

    return run


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field_name, text, kinds, suspects) to (id, field_name, text, kinds, lines, keys): suspects laid out."""
    for b in batches:
        lines, keys = [], []
        for text, found in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
            known: dict[str, list] = {}
            for r in found:
                known.setdefault(r["wrong"], []).append((r["right"], r["n_right"], r["logp"], r["n_wrong"]))
            for o in known.values():
                o.sort(key=lambda x: (-x[2] - math.log(x[1]), x[0]))
            ln = lattice(text, known) if known else []
            lines.append(json.dumps(ln) if ln else None)
            keys.append(lattice_keys(ln) if ln else None)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(lines, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "field_name", "text", "kinds", "lines", "keys"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        texts, kinds = [], []
        for text, ks, lines, keys, ns in zip(col["text"], col["kinds"], col["lines"], col["ks"], col["ns"]):
            if lines:
                changes = decode(json.loads(lines), dict(zip(keys or (), ns or ())))
                if changes:
                    text = replaced(text, changes)
                    ks = sorted({*ks, "misread"})
            texts.append(text)
            kinds.append(ks)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "field_name", "text", "kinds"])


def repaired(questions: DataFrame, every: bool = True) -> DataFrame:
    """(id, field_name, text, kinds): each field repaired, with the kinds of noise found in it. Without ``every``,
    only fields with noise, and the text only where words changed."""
    spark = questions.sparkSession
    counts = census(questions)
    bad = written(suspects(counts), "p5-suspects")
    bits = np.zeros(-(-BITS // 8), dtype=np.uint8)
    for r in bad.select("wrong").coalesce(16).mapInArrow(_bitmap(BITS), "bits binary").collect():
        bits |= np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast((bits.tobytes(), every))
    fields = _fields(questions, counts).mapInArrow(_first(shared, BITS), "id string, field_name string, text string, kinds array<string>, maybe array<string>")
    fields = written(fields.distinct(), "p5-fields")
    option = F.struct("wrong", "right", "n_right", "logp", "n_wrong")
    own = fields.where("maybe is not null").withColumn("wrong", F.explode("maybe")).join(bad, "wrong", "left").groupBy("id", "field_name", "text", "kinds").agg(F.collect_list(F.when(F.col("right").isNotNull(), option)).alias("suspects"))
    first = own.mapInArrow(_lay, "id string, field_name string, text string, kinds array<string>, lines string, keys array<bigint>")
    pairs = counts.where("kind = 2").select("key", "n")
    first = first.withColumn("h", F.xxhash64("text", "kinds"))
    ask = first.select("id", "field_name", "h", F.explode("keys").alias("key")).join(pairs, "key")
    got = ask.groupBy("id", "field_name", "h").agg(F.collect_list("key").alias("ks"), F.collect_list("n").alias("ns"))
    laid = first.join(got, ["id", "field_name", "h"], "left").select("id", "field_name", "text", "kinds", "lines", "ks", "ns")
    decoded = laid.mapInArrow(_second, "id string, field_name string, text string, kinds array<string>")
    return fields.where("maybe is null").select("id", "field_name", "text", "kinds").unionByName(decoded)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "question").select("id", "path", "stem", "explanation")
    return repaired(q, every=False).select("id", "field_name", F.explode("kinds").alias("noise")).distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "question").select("id", "path", "stem", "explanation")
    return repaired(q).select("id", "field_name", "text", F.array_join("kinds", ",").alias("kinds"))
