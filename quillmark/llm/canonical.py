"""Problem 4: free-typed values mapped to a canonical list.

A symmetric-delete dictionary of the reference list is broadcast. Each distinct value of an Arrow batch is looked up
once: several readings of the value (without notes, numbering and labels; commas turned round; without spaces) find
every entry within a bounded edit distance; words found the same way, or as abbreviations, are aligned with each
entry's words. Candidates are ranked by weighted Damerau-Levenshtein distance, then by how often the entry is typed
exactly. What nothing matches is reported with -1.

A list of more than ``BLOCK`` entries goes through in blocks, one broadcast at a time: every block gives its evidence
on each distinct value (best distance, ties, alignments), and the evidence of all blocks is settled by the very rules
that settle one block. Word weights and frequencies are those of the whole list in either case.

Cases: null values are left out; values equal to an entry of their field give no row; blank values and bare marks
give -1; ties between entries that cannot be told apart give -1; an empty list gives -1 for every value.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.lookalike import key
from quillmark.runtime import table, written

FIELDS = ("topic", "exam", "pyqExam")
#: Entries of the reference list in one broadcast.
BLOCK = 20_000
#: Characters of a key whose deletions are stored.
PREFIX = 9
#: Most edits of a whole key, of a word.
MOST, MOST_WORD = 3, 2

#: Words without weight of their own.
SMALL = frozenset("a an the of in on to for from by with and its it is at".split())
#: Words that only describe the sitting, the place in a book or the writer's note.
NOTES = frozenset(
    "exam exams examination course main mains advanced ug pg final stage level set paper papers shift part revision revise imp important topic topics sub subtopic chapter ch unit lesson section sec no year old new session phase round series vol".split()
)
_ROMAN = re.compile(r"^(?:[ivx]{1,4}|[a-d]|\d+)$")
#: Common short spellings, as fixed values.
SHORT = {"b/w": "between", "rxn": "reaction", "rxns": "reactions", "engg": "engineering", "maths": "mathematics", "math": "mathematics", "govt": "government", "dept": "department", "univ": "university", "&": "and", "w/": "with", "w/o": "without", "exam": "examination"}

_VOWELS = frozenset("aeiou")


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein (restricted): a swap costs 0.7, a doubled or undoubled letter 0.5, a vowel for a
    vowel 0.8, anything else 1. Above ``most``, infinity."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) * 0.5 > most:
        return math.inf
    two: list[float] = []
    one = [0.0]
    for j in range(1, len(b) + 1):
        one.append(one[-1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        x = a[i - 1]
        drop = 0.5 if i > 1 and x == a[i - 2] else 1.0
        row = [one[0] + drop]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            sub = 0.0 if x == y else 0.8 if x in _VOWELS and y in _VOWELS else 1.0
            best = min(one[j - 1] + sub, one[j] + drop, row[j - 1] + (0.5 if j > 1 and y == b[j - 2] else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, two[j - 2] + 0.7)
            row.append(best)
        if min(row) > most:
            return math.inf
        two, one = one, row
    return one[-1] if one[-1] <= most else math.inf


def edits(a: str, b: str) -> int:
    """Restricted Damerau-Levenshtein distance: every edit and every swap of neighbours counts one."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j - 1] + (x != y), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def reach(n: int) -> int:
    """Edits allowed where the longer of two keys has n characters."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 11 else 3


def deletes(word: str, k: int) -> set[str]:
    """What is left of the word's first PREFIX characters without up to k of them. Two words k edits apart share one:
    in an alignment of both, at most k characters of either prefix have no partner in the other prefix."""
    p = word[:PREFIX]
    out = {p}
    for n in range(1, min(k, len(p) - 1) + 1):
        for at in combinations(range(len(p)), n):
            out.add("".join(c for i, c in enumerate(p) if i not in at))
    return out


class SymmetricDeletes:
    """Keys by the deletions of their prefixes: every key within the bound of the longer of both shares one with the query."""

    def __init__(self, keys: set[str], most: int = MOST) -> None:
        self.most = most
        self.at: dict[str, list[str]] = defaultdict(list)
        for w in sorted(keys):
            for d in deletes(w, self._room(w)):
                self.at[d].append(w)

    def _room(self, w: str) -> int:
        """The largest bound of any pair the key can be in: a partner is at most ``most`` characters longer."""
        return min(self.most, reach(len(w) + self.most))

    def near(self, q: str) -> list[tuple[float, str]]:
        """(weighted distance, key) of every key within the bound."""
        seen: set[str] = set()
        out = []
        for d in deletes(q, self._room(q)):
            for w in self.at.get(d, ()):
                if w not in seen:
                    seen.add(w)
                    r = min(self.most, reach(max(len(q), len(w))))
                    # no edit weighs under a half
                    if abs(len(w) - len(q)) <= r and (c := distance(q, w, r)) <= r and (2 * c <= r or edits(q, w) <= r):
                        out.append((c, w))
        return sorted(out)


_PIECE = re.compile(r"[a-z0-9]+(?:'[a-z]+)?/?[a-z]*|&")
_BRACKET = re.compile(r"[(\[{]([^)\]}]*)[)\]}]")
_LABEL = re.compile(r"^\s*(?:(?:sub[- ]?topic|topic|chapter|chap|ch)\b\s*(?:[.:\-–]+|(?=[^\W\d_]))\s*|(?:chapter|chap|ch|unit|lesson|section|sec)\b[\s.:\-–]*\d+[\s.:)\-–]+|\(?\d{1,3}[.):\-]\s*|[-*•]\s+)+", re.I)
_YEAR = re.compile(r"(?:['’`]\s?\d{2}|\b(?:19|20)\d{2})\b")
_TAIL = re.compile(r"[\s,\-–]*\b(?:set|paper|shift|stage|part|level|phase|session)\s*[-–]?\s*(?:[a-d]|[ivx]{1,4}|\d{1,2})?\s*$", re.I)


def compact(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def pieces(text: str) -> list[str]:
    """The words of a key, short spellings written out."""
    return [SHORT.get(w, w) for w in re.findall(r"[^\W_]+(?:/[^\W_]+)?|&", text)]


def readings(value: str) -> list[str]:
    """Ways to read a typed value, as keys: as it is, without notes, brackets turned or alone, commas turned."""
    k = key(value).replace("_", " ")
    base = _LABEL.sub("", k).strip() or k
    out = [k, base]
    inner = [x.strip() for x in _BRACKET.findall(base) if x.strip()]
    bare = " ".join(_BRACKET.sub(" ", base).split()) or base
    bare = _YEAR.sub(" ", bare).strip(" -–,.:;'")
    out.append(bare)
    out.append(_TAIL.sub("", bare).strip(" -–,.:;"))
    for x in inner:
        out += [x, f"{x} {bare}"]
    for t in list(out):
        if "," in t:
            left, _, right = t.partition(",")
            out.append(f"{right.strip()} {left.strip()}")
    return list(dict.fromkeys(x for x in out if x))


def entry_words(text: str) -> list[str]:
    """The words of an entry that carry weight."""
    ws = pieces(key(text))
    return [w for w in ws if w not in SMALL] or ws


class Mapper:
    """Entries (canon_id, text, short form, frequency) of one field, or a block of them. ``counts``: in how many entries
    of the whole list each word stands; ``total``: entries of the whole list."""

    def __init__(self, entries: list[tuple[int, str, str | None, int]], counts: dict[str, int] | None = None, total: int | None = None) -> None:
        self.entries = entries
        self.by_key: dict[str, set[int]] = defaultdict(set)
        self.acronym: dict[str, set[int]] = defaultdict(set)
        content = []
        own: dict[str, int] = defaultdict(int)
        for i, (_, text, short, _) in enumerate(entries):
            ws = pieces(key(text))
            self.by_key[compact(key(text))].add(i)
            self.by_key["".join(w for w in ws if w not in SMALL)].add(i)
            self.by_key["".join(ws)].add(i)
            if short:
                self.acronym[compact(key(short))].add(i)
            content.append(entry_words(text))
            for w in set(content[-1]):
                own[w] += 1
        df = counts or own
        self.words: list[dict[str, float]] = [{w: math.log(1 + (total or len(entries)) / df[w]) for w in ws} for ws in content]
        self.deletes = SymmetricDeletes(set(self.by_key))
        self.vocabulary = SymmetricDeletes(set(own) | SMALL, MOST_WORD)
        self.having: dict[str, list[int]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w in ws:
                self.having[w].append(i)
        self.sorted_words = sorted(own)
        self._meant: dict[str, dict[str, float]] = {}

    def _word(self, w: str) -> dict[str, float]:
        """Entry words a typed word may stand for, with how well: those near it, and those it is the beginning of."""
        if (out := self._meant.get(w)) is None:
            if len(self._meant) > 100_000:
                self._meant.clear()
            out = self._meant[w] = {}
            for c, v in self.vocabulary.near(w):
                out[v] = max(out.get(v, 0), 1 - 0.12 * c)
            if len(w) >= 3:
                for n in range(bisect_left(self.sorted_words, w), len(self.sorted_words)):
                    v = self.sorted_words[n]
                    if not v.startswith(w):
                        break
                    if len(v) > len(w):
                        out[v] = max(out.get(v, 0), 0.85 + 0.1 * len(w) / len(v))
        return out

    def evidence(self, value: str, whole: bool = False) -> dict:
        """What these entries have to say on a value, as settle() takes it: entries (id, frequency) whose short form is
        each reading; the least distance, with the entries at it; the two best alignments of each reading. Unless the
        ``whole`` is asked for, what the entries here already settle is not looked into further."""
        views = readings(value)
        tell = lambda i: [self.entries[i][0], self.entries[i][3]]
        short = [[tell(i) for i in sorted(self.acronym.get(compact(v), ()))] for v in views]
        if not whole and any(len({i for i, _ in per}) == 1 for per in short):
            return {"short": short, "best": None, "at": [], "aligned": []}
        best, at = math.inf, {}
        for v in views:
            words = pieces(v)
            for c in dict.fromkeys((compact(v), "".join(words), "".join(w for w in words if w not in NOTES), "".join(w for w in words if w not in SMALL))):
                if c in self.by_key:
                    hits = [(0.0, i) for i in self.by_key[c]]
                elif len(c) >= 3:
                    hits = [(d, i) for d, w in self.deletes.near(c) for i in self.by_key[w] if d <= max(1, 0.2 * min(len(c), len(w)))]
                else:
                    continue
                for d, i in hits:
                    if d < best - 1e-9:
                        best, at = d, {}
                    if d <= best + 1e-9:
                        at[i] = None
        aligned = [[[x, *tell(i)] for x, i in self._align(pieces(v))] for v in views] if whole or len(at) != 1 else []
        return {"short": short, "best": best if at else None, "at": [tell(i) for i in sorted(at)], "aligned": aligned}

    def find(self, value: str) -> int | None:
        """The entry a value means, or None."""
        return settle([self.evidence(value)])

    def _align(self, words: list[str]) -> list[tuple[float, int]]:
        """The two entries that best fit: weighted words nearly all met, hardly a typed word left over."""
        own = [w for w in words if w not in SMALL and (w in self.having or (w not in NOTES and not _ROMAN.match(w)))] or [w for w in words if w not in SMALL]
        if not own:
            return []
        met: dict[int, dict[str, float]] = defaultdict(dict)
        used: dict[int, int] = defaultdict(int)
        for w in own:
            hit: set[int] = set()
            for v, q in self._word(w).items():
                for i in self.having.get(v, ()):
                    met[i][v] = max(met[i].get(v, 0), q)
                    hit.add(i)
            for i in hit:
                used[i] += 1
        out = []
        for i, m in met.items():
            total = sum(self.words[i].values())
            cover = sum(self.words[i][v] * q for v, q in m.items()) / total
            left = len(own) - used[i]
            if cover >= 0.72 and left * 3 <= len(own):
                out.append((3 + 4 * (1 - cover) + left, i))
        return sorted(out)[:2]


def _most_frequent(at: list) -> int | None:
    """Of entries (id, frequency) the most frequent one; none where that does not tell."""
    most = max(n for _, n in at)
    ids = {i for i, n in at if n == most}
    return ids.pop() if len(ids) == 1 else None


def settle(blocks: list[dict]) -> int | None:
    """The entry a value means, from the evidence of all blocks of the list: a short form that one entry has, the least
    distance, the best alignment with a clear lead; of equals the more frequent one."""
    for per in zip(*(b["short"] for b in blocks)):
        ids = {i for own in per for i, _ in own}
        if len(ids) == 1:
            return ids.pop()
    near = [b for b in blocks if b["best"] is not None]
    if near:
        least = min(b["best"] for b in near)
        if (i := _most_frequent([x for b in near if b["best"] <= least + 1e-9 for x in b["at"]])) is not None:
            return i
    got: list[tuple[float, int, int]] = []
    for per in zip(*(b["aligned"] for b in blocks)):
        top = sorted(x for b in per for x in b)[:2]
        if top and not (len(top) > 1 and top[0][1] != top[1][1] and top[1][0] - top[0][0] < 0.05):
            got.append(tuple(top[0]))
    if got:
        least = min(got)[0]
        return _most_frequent([(i, n) for x, i, n in got if x <= least + 1e-9])
    return None


def _run(mappers):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {f: Mapper(*m) for f, m in mappers.value.items()}
        exact = {f: {t for _, t, _, _ in m.entries} for f, m in of.items()}
        find = {f: lru_cache(1 << 16)(m.find) for f, m in of.items()}
        for b in batches:
            ids = b.column(0)
            for n, f in enumerate(FIELDS):
                enc = b.column(n + 1).dictionary_encode()
                canon = [None if v in exact[f] else -1 if (r := find[f](v)) is None else r for v in enc.dictionary.to_pylist()]
                c = pa.array(canon, pa.int32()).take(enc.indices)
                keep = c.is_valid()
                yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array([f] * keep.true_count, pa.string()), c.filter(keep)], names=["id", "field_name", "canon_id"])

    return go


def _tell(mappers):
    """Distinct values (field_name, value) to the evidence of one block."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {f: Mapper(*m) for f, m in mappers.value.items()}
        for b in batches:
            said = [json.dumps(of[f].evidence(v, whole=True)) for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], names=["field_name", "value", "said"])

    return go


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [settle([json.loads(x) for x in said]) for said in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-1 if g is None else g for g in got], pa.int32())], names=["field_name", "value", "canon_id"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ws = [sorted(set(entry_words(t))) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ws, pa.list_(pa.string()))], names=[*b.schema.names, "words"])


def reference(questions: DataFrame, canon: DataFrame) -> DataFrame:
    """The list with what is known of all of it: (canon_id, field_name, canon_text, short_form, n, counts); n is how
    often the entry is typed exactly (counted per distinct value before the join), counts in how many entries of its
    field each of its words stands."""
    typed = None
    for f in FIELDS:
        one = questions.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("canon_text")).agg(F.count("*").alias("n")).withColumn("field_name", F.lit(f))
        typed = one if typed is None else typed.unionByName(one)
    canon = canon.select("canon_id", "field_name", "canon_text", "short_form").distinct()
    own = canon.mapInArrow(_words, "canon_id int, field_name string, canon_text string, short_form string, words array<string>")
    each = own.select("canon_id", "field_name", "canon_text", F.explode("words").alias("word"))
    df = each.groupBy("field_name", "word").agg(F.count("*").cast("int").alias("df"))
    counts = each.join(df, ["field_name", "word"]).groupBy("canon_id", "field_name", "canon_text").agg(F.collect_set(F.struct("word", "df")).alias("counts"))
    out = canon.join(counts, ["canon_id", "field_name", "canon_text"], "left").join(typed, ["field_name", "canon_text"], "left")
    return out.select("canon_id", "field_name", "canon_text", "short_form", F.coalesce("n", F.lit(0)).alias("n"), "counts")


def _blocks(ref: DataFrame) -> Iterator[list]:
    """The list in blocks of at most BLOCK entries, one at a time."""
    block: list = []
    for r in ref.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _mappers(block: list, totals: dict[str, int]) -> dict[str, tuple]:
    own: dict[str, tuple] = {f: ([], {}, totals.get(f, 0)) for f in FIELDS}
    for r in block:
        own[r.field_name][0].append((r.canon_id, r.canon_text, r.short_form, r.n))
        own[r.field_name][1].update({c.word: c.df for c in r.counts or ()})
    return own


def mapped(questions: DataFrame, canon: DataFrame) -> DataFrame:
    """(id, field_name, canon_id) for every value that is not an entry of its field, -1 where it means none."""
    spark = questions.sparkSession
    canon = canon.where(F.col("canon_text").isNotNull() & F.col("canon_id").isNotNull() & F.col("field_name").isin(*FIELDS))
    ref = reference(questions, canon).orderBy("field_name", "canon_id", "canon_text")
    totals = {r.field_name: r.n for r in canon.groupBy("field_name").agg(F.count_distinct("canon_id", "canon_text", F.coalesce("short_form", F.lit(""))).alias("n")).collect()}
    q = questions.where("id is not null").select("id", *FIELDS)
    if sum(totals.values()) <= BLOCK:
        shared = spark.sparkContext.broadcast(_mappers(ref.collect(), totals))  # at most BLOCK rows
        return q.mapInArrow(_run(shared), "id string, field_name string, canon_id int").distinct()
    long = q.select("id", F.expr("stack(3, 'topic', topic, 'exam', exam, 'pyqExam', pyqExam) as (field_name, value)")).where("value is not null").distinct()
    asked = written(long.join(canon.select("field_name", F.col("canon_text").alias("value")).distinct(), ["field_name", "value"], "left_anti"), "p4-asked")
    values = written(asked.select("field_name", "value").distinct(), "p4-values")
    said = None
    for b in _blocks(written(ref, "p4-list").orderBy("field_name", "canon_id", "canon_text")):
        shared = spark.sparkContext.broadcast(_mappers(b, totals))
        own = written(values.mapInArrow(_tell(shared), "field_name string, value string, said string"), "p4-said")
        shared.destroy()
        said = own if said is None else said.unionByName(own)
    meant = said.groupBy("field_name", "value").agg(F.collect_list("said").alias("said")).mapInArrow(_settle, "field_name string, value string, canon_id int")
    return asked.join(meant, ["field_name", "value"]).select("id", "field_name", "canon_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(table(spark, sf_dir, "question").select("id", *FIELDS), table(spark, sf_dir, "canonical_value"))
