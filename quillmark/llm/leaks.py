"""Problem 7: evaluation texts leaking into training text (containment search).

Items are partitioned by size. For each partition every document is read as overlapping windows of twice the
partition's largest item, so that short items meet sets of comparable size however long the document is. Windows and
items are compared by MinHash; a pair whose equal values reach what the least containment implies is a candidate.
Candidates are verified exactly: containment of the item's five-word shingles in the window, then the longest run of
the item's words, in order and on one diagonal, with at most one changed (substituted) word in ten.

Items so short that their least containment leaves MinHash too little to go by are looked up by their shingles
instead, exactly; items of under ten words, of which half holds no shingle for certain, by the runs of half their
words (so few words leave none to change).

The items are the stated query set: they are read in blocks of at most ``BLOCK`` and broadcast block by block; all
documents pass each block. Nothing of the documents is shuffled or collected; a worker builds a block's index once.

Cases: null and empty texts hold nothing; repeated texts each count under their own id; an empty item table gives no
rows. Words are pieces between white space without marks, lower-cased.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.lookalike import display
from quillmark.runtime import table, written

SHINGLE = 5
#: Part of an item's words a passage must hold, and the part of those that may differ.
SHARE, CHANGED = 0.5, 0.1
HASHES = 144
#: Chance that MinHash passes over a pair with the least containment a passage can have.
MISS = 0.002
#: Ratio of the size partitions' bounds; items in one broadcast; shingles worked on at once; unit of window sizes.
STEP, BLOCK, CHUNK, BASE = 1.25, 20_000, 20_000, 8

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_ROLL = (_rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MARKS = re.compile(r"[^\w\s]+|_+")


def words_of(text: str) -> list[str]:
    """Lower-cased pieces without marks; quotes, punctuation and line breaks do not count."""
    return _MARKS.sub("", display(text).lower()).split()


def hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        s += h[k : k + n] * _ROLL[k]
        s ^= s >> np.uint64(31)
    return s * np.uint64(0x9E3779B97F4A7C15)


def minhash(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(32)).astype(np.uint32)[:, None] ^ _ADD) * _MUL


def block_minhash(s: np.ndarray) -> np.ndarray:
    """Least MinHash values of each BASE shingles in a row: halved three times while still in the cache."""
    n = -(-len(s) // BASE)
    out = np.empty((n, HASHES), dtype=np.uint32)
    step = 2048 // BASE
    for i in range(0, n, step):
        h = minhash(s[i * BASE : (i + step) * BASE])
        if short := -len(h) % BASE:
            h = np.concatenate([h, np.repeat(h[-1:], short, axis=0)])
        while len(h) > min(step, n - i):
            h = np.minimum(h[0::2], h[1::2])
        out[i : i + step] = h
    return out


def least_containment(n: int) -> float:
    """The least share of an item's shingles (item of n words) that a passage keeps: half of the words or more, each
    changed word, one in ten, breaking SHINGLE shingles. A longer passage may keep fewer, where one more may change."""
    kept = min(part - SHINGLE + 1 - SHINGLE * int(CHANGED * part + 1e-6) for part in range(int(np.ceil(SHARE * n)), n + 1))
    return max(1, kept) / (n - SHINGLE + 1)


def least_equal(mean: float) -> int:
    """The most equal MinHash values one may ask for, so that a pair with this mean is missed with at most MISS."""
    m, p, below = 0, float(np.exp(-mean)), 0.0
    while below + p <= MISS:
        below += p
        m += 1
        p *= mean / m
    return max(1, m)


def longest_run(item: np.ndarray, doc: np.ndarray, shift: int) -> int:
    """The longest stretch of the item's words that stands in the document at this shift with few enough changed."""
    n = len(item)
    at = np.arange(n) + shift
    ok = (at >= 0) & (at < len(doc))
    same = np.zeros(n, dtype=bool)
    same[ok] = item[ok] == doc[at[ok]]
    bad = np.concatenate([[0], np.cumsum(~same)])
    # bad[b] - bad[a] <= CHANGED * (b - a)  <=>  v[b] <= v[a] with v = bad - CHANGED * position
    v = bad - CHANGED * np.arange(n + 1)
    least = np.minimum.accumulate(v[::-1])[::-1]  # the smallest v from here on
    best = 0
    for a in np.flatnonzero(same):
        # least rises: the last position where it is still at most v[a] ends the longest stretch from a
        best = max(best, int(np.searchsorted(least, v[a] + 1e-6, side="right")) - 1 - int(a))
    return best


class Runs:
    """Where runs of ``size`` words stand in items, by hash."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]]) -> None:
        self.size = size
        rows = [shingles(h, size) for _, h in items]
        code = np.concatenate(rows)
        item = np.repeat(np.array([x for x, _ in items]), [len(r) for r in rows])
        at = np.concatenate([np.arange(len(r)) for r in rows])
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.at = code[order], item[order], at[order]

    def hits(self, row: np.ndarray) -> np.ndarray:
        """Distinct (item, shift) of the runs that stand in a document's row of hashed runs."""
        lo = self.code.searchsorted(row, "left")
        some = np.flatnonzero((lo < len(self.code)) & (self.code[np.minimum(lo, len(self.code) - 1)] == row))
        if not len(some):
            return np.empty((0, 2), dtype=np.int64)
        lo, n = lo[some], self.code.searchsorted(row[some], "right") - lo[some]
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([self.item[which], np.repeat(some, n) - self.at[which]], axis=1), axis=0)


class Items:
    """One block of items, by size partition."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        known: dict[str, int] = {}
        self.ids, self.words, self.grams = [], [], []
        halves: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, text in rows:
            h = hashes(words_of(text), known)
            if not len(h):
                continue
            if len(h) < 2 * SHINGLE:
                halves[-(-len(h) // 2)].append((i, h))
                continue
            self.ids.append(i)
            self.words.append(h)
            self.grams.append(np.unique(shingles(h)))
        self.halves = [Runs(k, own) for k, own in sorted(halves.items())]
        self.need = np.array([least_containment(len(w)) * len(g) - 1e-9 for w, g in zip(self.words, self.grams)])
        groups: dict[int, list[int]] = defaultdict(list)
        for x, g in enumerate(self.grams):
            groups[int(np.ceil(np.log(len(g)) / np.log(STEP)))].append(x)
        self.parts = []
        exact: list[tuple[int, np.ndarray]] = []
        sized: list[np.ndarray] = []
        for k, xs in sorted(groups.items()):
            upper = -(-int(np.ceil(STEP**k)) // BASE) * BASE
            j = min((s := least_containment(len(self.words[x])) * (g := len(self.grams[x]))) / (g + 2 * upper - s) for x in xs)
            if np.exp(-HASHES * j) > MISS:  # even one equal value is too much to ask for
                exact += [(x, self.words[x]) for x in xs]
                continue
            sized += [self.grams[x] for x in xs]
            need = least_equal(HASHES * j)
            code = np.concatenate([minhash(self.grams[x]).min(axis=0).astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)) for x in xs])
            own = np.repeat(np.array(xs), HASHES)
            order = np.argsort(code, kind="stable")
            code, own = code[order], own[order]
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)] = True
            self.parts.append((upper, need, code, own, sieve))
        self.exact = Runs(SHINGLE, exact) if exact else None
        self.every = np.unique(np.concatenate(sized)) if sized else np.zeros(1, dtype=np.uint64)


def candidates(s: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, from, to): windows of the shingle row whose MinHash values equal enough of an item's. A window that holds
    fewer shingles of all items together than the one item needs is none (an upper bound, so nothing is lost)."""
    at = items.every.searchsorted(s)
    at[at == len(items.every)] = 0
    shared = np.concatenate([[0], np.cumsum(items.every[at] == s)])  # shingles of any item up to here
    over = max((2 * p[0] for p in items.parts), default=0)
    slots = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
    for at in range(0, len(s), CHUNK):
        own = s[at : at + CHUNK + over]
        m = block_minhash(own)
        for upper, need, code, whose, sieve in items.parts:
            blocks = np.minimum.reduceat(m, np.arange(0, len(m), upper // BASE), axis=0)
            win = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
            c = (win.astype(np.uint64) | slots).ravel()
            maybe = np.flatnonzero(sieve[(c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)])
            v = c[maybe]
            lo, hi = np.searchsorted(code, v, "left"), np.searchsorted(code, v, "right")
            hit = hi > lo
            lo, n, w = lo[hit], (hi - lo)[hit], maybe[hit] // HASHES
            if not len(lo):
                continue
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair, count = np.unique(np.repeat(w, n) * np.int64(1 << 32) + whose[np.repeat(lo, n) + step], return_counts=True)
            pair = pair[count >= need]
            which, start = pair & 0xFFFFFFFF, at + (pair >> 32) * upper
            good = shared[np.minimum(start + 2 * upper, len(s))] - shared[start] >= items.need[which]
            for x, a in zip(which[good].tolist(), start[good].tolist()):
                yield x, a, a + 2 * upper


def found_in(docs: list[np.ndarray], items: Items) -> list[tuple[int, int]]:
    """(position of the document, item id) for documents given as word hashes. Their shingles stand in one row: a
    window over two documents can only add candidates, and every candidate is verified within one document."""
    out: set[tuple[int, int]] = set()
    for runs in items.halves:
        out.update((d, int(i)) for d, doc in enumerate(docs) for i in runs.hits(shingles(doc, runs.size))[:, 0])
    rows = [shingles(d) for d in docs]
    if items.exact:
        for d, doc in enumerate(docs):
            for x, shift in items.exact.hits(rows[d]).tolist():
                if longest_run(items.words[x], doc, shift) >= SHARE * len(items.words[x]):
                    out.add((d, items.ids[x]))
    ends = np.cumsum([len(r) for r in rows])
    if not items.parts or not len(ends) or not ends[-1]:
        return sorted(out)
    row = np.concatenate(rows)
    for x, start, end in candidates(row, items):
        for d in range(int(np.searchsorted(ends, start, "right")), len(docs)):
            off = int(ends[d]) - len(rows[d])
            if off >= end:
                break
            if (d, items.ids[x]) not in out and verified(docs[d], rows[d], max(0, start - off), end - off, items.words[x], items.grams[x], items.need[x]):
                out.add((d, items.ids[x]))
    return sorted(out)


def verified(doc: np.ndarray, s: np.ndarray, start: int, end: int, item: np.ndarray, grams: np.ndarray, need: float) -> bool:
    """Exact shingle containment of the item in the window, then one passage of its words."""
    window = s[start:end]
    if len(window) < need:
        return False
    at = grams.searchsorted(window)
    at[at == len(grams)] = 0
    inside = grams[at] == window
    if np.count_nonzero(inside) < need or len(np.unique(window[inside])) < need:
        return False
    own = shingles(item)
    shifts: dict[int, int] = defaultdict(int)
    for q in np.flatnonzero(inside):
        for p in np.flatnonzero(own == window[q]):
            shifts[start + int(q) - int(p)] += 1
    need = SHARE * len(item)
    return any(longest_run(item, doc, d) >= need for d, _ in sorted(shifts.items(), key=lambda x: -x[1]))


_built: dict[str, Items] = {}


def _index(name: str, rows: list[tuple[int, str]]) -> Items:
    """The index of a block, built once in each worker; the last one only is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(rows)
    return _built[name]


def _search(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(name, shared.value)
        known: dict[str, int] = {}
        for b in batches:
            docs, got = [], []
            ids: list[int] = []
            row: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                for d, i in found_in(row, items):
                    docs.append(ids[d])
                    got.append(i)
                ids.clear()
                row.clear()

            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    ids.append(d)
                    row.append(hashes(words_of(text), known))
                    size += len(row[-1])
                    if size > CHUNK:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(got, pa.int32())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item."""
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    block: list[tuple[int, str]] = []
    out = spark.createDataFrame([], "doc_id bigint, item_id int")
    rows = items.where("item_id is not null and text is not null").select("item_id", "text")
    several = rows.limit(BLOCK + 1).count() > BLOCK

    def search(own: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(own)
        found = docs.mapInArrow(_search(shared, uuid.uuid4().hex), "doc_id bigint, item_id int")
        if several:  # one block at a time on the driver and the executors
            found = written(found, "p7")
            shared.destroy()
        return found

    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == BLOCK:
            out = out.unionByName(search(block))
            block = []
    if block:
        out = out.unionByName(search(block))
    return out.distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that leak it."""
    items = table(spark, sf_dir, "eval_item").select("item_id", "origin")
    n = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.join(n, "item_id", "left").select("item_id", "origin", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
