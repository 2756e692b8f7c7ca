"""Problem 1: near-duplicate records with small edits (similarity join on word sets).

Candidates come from banded MinHash. Each candidate pair is then pruned the Bayesian way: the pair's one-bit
MinHash values are compared 64 at a time, and the pair is dropped as soon as the posterior probability (uniform
prior on the similarity) that it reaches the threshold falls below ``TOLERANCE``. What survives is verified exactly.

Shape of the plan. Exact copies collapse first (``dropDuplicates`` combines before its shuffle), so a text copied
a million times costs one row afterwards. Band keys travel as packed binary blocks, one per ``GATHER`` texts and target
partition, so that the shuffle moves few rows and no per-row overhead; there are as many partitions as the counted
texts ask for (``PART_ROWS`` band rows each). A bucket with more than ``BLOCK`` members leaves its task as blocks; their
pairs are made by a join of blocks, spread over all tasks again.

Cases: null stems, and stems with fewer than ``MIN_WORDS`` distinct words, have no partner. Repeated rows of one id
count once. An id that arrives with two different stems takes part with each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.runtime import discard, shuffle_partitions, table, written

#: Fixed by the problem's statement.
EDGE = ".,;:?!()[]\"'\\"
MIN_WORDS = 12
THRESHOLD = 0.75

#: MinHash layout: ROWS values a band; BANDS bands. At similarity 0.75 a pair is missed with probability
#: (1 - 0.75**6)**30 = 0.003, at 0.8 with 1e-4, at 0.85 with 1e-6.
ROWS, BANDS = 6, 30
SIG_WORDS = 2
TOLERANCE = 1e-4
#: Members of a bucket compared in one go; texts gathered into one packed block; band rows a partition.
BLOCK, GATHER, PART_ROWS = 8192, 32_768, 2_000_000


def words_of(text: str) -> set[str]:
    """The words of a text: distinct lower-cased pieces without the marks at both ends."""
    return {w for w in (x.strip(EDGE) for x in text.lower().split()) if w}


def least_matches(k: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of k equal one-bit MinHash values with which a pair stays: below, the posterior probability
    that its similarity reaches the threshold is under the tolerance."""
    j = (np.arange(4000) + 0.5) / 4000
    p = (1 + j) / 2  # two one-bit values are equal with this probability
    for m in range(k + 1):
        log = m * np.log(p) + (k - m) * np.log1p(-p)
        w = np.exp(log - log.max())
        if w[j >= threshold].sum() / w.sum() >= tolerance:
            return m
    return k


_rng = np.random.default_rng(20260701)
_MUL = (_rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_MIX = (_rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signatures(sets: list[set[str]]) -> np.ndarray:
    """MinHash values of word sets, one row of ROWS * BANDS uint32 each. Every set has a word."""
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for s in sets for w in s), dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
    t = ((h[:, None] * _MUL + _ADD) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    out = np.empty((len(sets), ROWS * BANDS), dtype=np.uint32)
    step = 256
    for i in range(0, len(sets), step):
        j = min(i + step, len(sets))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = np.minimum.reduceat(t[at[lo:hi]], starts[i:j] - lo, axis=0)
    return out


_ROW = np.dtype([("key", "<u4"), ("doc", "<i8"), ("n", "u1"), ("sig", "<u8", (SIG_WORDS,))])


def band_rows(docs: list[int], sets: list[set[str]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, row) of every band of every text."""
    sig = signatures(sets)
    size = np.minimum([len(s) for s in sets], 255).astype(np.uint8)
    bits = np.packbits((sig[:, : 64 * SIG_WORDS] & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    key = (sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=2, dtype=np.uint64)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    row = np.empty(len(docs) * BANDS, dtype=_ROW)
    row["key"] = key.ravel().astype(np.uint32)
    row["doc"], row["n"], row["sig"] = (np.repeat(x, BANDS, axis=0) for x in (np.array(docs, dtype=np.int64), size, bits))
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64).ravel(), row


def _emit(parts: int):
    """Batches of (k, stem) to packed blocks of band rows: (part, rows)."""

    def packed(part: list[np.ndarray], row: list[np.ndarray]) -> pa.RecordBatch:
        p, r = np.concatenate(part), np.concatenate(row)
        order = np.argsort(p, kind="stable")
        p, r = p[order], r[order]
        ids, at = np.unique(p, return_index=True)
        cuts = np.append(at, len(p))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([r[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, held = [], [], 0
        for b in batches:
            docs, sets = [], []
            for k, s in zip(b.column(0).to_numpy(), b.column(1).to_pylist()):
                w = words_of(s)
                if len(w) >= MIN_WORDS:
                    docs.append(k)
                    sets.append(w)
            if not docs:
                continue
            p, r = band_rows(docs, sets, parts)
            part.append(p)
            row.append(r)
            held += len(docs)
            if held >= GATHER:
                yield packed(part, row)
                part, row, held = [], [], 0
        if held:
            yield packed(part, row)

    return run


_LEAST = [least_matches(64 * (w + 1)) for w in range(SIG_WORDS)]


def _survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bayesian pruning of row pairs: compare one-bit MinHash values a word at a time."""
    small, large = np.minimum(a["n"], b["n"]), np.maximum(a["n"], b["n"])
    keep = np.flatnonzero((a["doc"] != b["doc"]) & ((small >= THRESHOLD * large) | (large == 255)))
    equal = np.zeros(len(keep), dtype=np.int64)
    for w in range(SIG_WORDS):
        equal = equal + 64 - np.bitwise_count(a["sig"][keep, w] ^ b["sig"][keep, w])
        good = equal >= _LEAST[w]
        keep, equal = keep[good], equal[good]
    return keep


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("i", pa.int32()), ("of", pa.int32()), ("block", pa.binary())])
_FOUND = "a long, b long, bucket long, i int, of int, block binary"


def _pairs(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Surviving pairs among rows sorted by key; starts: positions whose key goes on in the next row."""
    d, alive, seen = 1, starts, []
    while len(alive):
        a, b = rows[alive], rows[alive + d]
        keep = _survivors(a, b)
        x, y = a["doc"][keep], b["doc"][keep]
        seen.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        if sum(map(len, seen)) > 500_000:
            yield from _batch(seen)
            seen = []
        d += 1
        alive = alive[alive + d < len(rows)]
        alive = alive[rows["key"][alive] == rows["key"][alive + d]]
    yield from _batch(seen)


def _batch(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if seen and len(p := np.unique(np.concatenate(seen), axis=0)):
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *(pa.nulls(len(p), t) for t in _OUT.types[2:])], schema=_OUT)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed rows of a partition to surviving pairs; oversized buckets come out as blocks, each once."""
    blocks, parts = [], []
    for b in batches:
        blocks += [v.as_buffer() for v in b.column(b.schema.get_field_index("rows"))]
        parts += [np.full(len(v) // _ROW.itemsize, p, dtype=np.int64) for p, v in zip(b.column(0).to_pylist(), blocks[-b.num_rows :])]
    if not blocks:
        return
    rows, part = np.concatenate([np.frombuffer(v, dtype=_ROW) for v in blocks]), np.concatenate(parts)
    del blocks, parts
    order = np.argsort(rows["key"], kind="stable")
    rows, part = rows[order], part[order]
    same = rows["key"][1:] == rows["key"][:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(first, len(rows)))
    large = size > BLOCK
    for f, n in zip(first[large].tolist(), size[large].tolist()):
        of = -(-n // BLOCK)
        bucket = (int(part[f]) << 32) | int(rows["key"][f])
        for i in range(of):
            block = rows[f + i * BLOCK : min(f + (i + 1) * BLOCK, f + n)].tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([v], t) for v, t in zip((bucket, i, of, block), _OUT.types[2:]))], schema=_OUT)
    ok = np.repeat(~large, size)
    yield from _pairs(rows, np.flatnonzero(same & ok[1:] & ok[:-1]))


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One or two blocks of an oversized bucket: pairs within the one, or across the two."""
    for batch in batches:
        for blocks in batch.column(batch.schema.get_field_index("blocks")):
            x, *more = (np.frombuffer(v.as_buffer(), dtype=_ROW) for v in blocks.values)
            if not more:
                for b in _pairs(x, np.arange(len(x) - 1)):
                    yield b.select(["a", "b"])
                continue
            y = more[0]
            for i in range(len(x)):
                a = np.repeat(x[i : i + 1], len(y))
                k = _survivors(a, y)
                if len(k):
                    p, q = a["doc"][k], y["doc"][k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def jaccard_reached(a: set[str], b: set[str], threshold: float = THRESHOLD) -> bool:
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for k1, s1, k2, s2 in zip(*(c.to_pylist() for c in b.columns)):
            x, y = words_of(s1), words_of(s2)
            if len(x) >= MIN_WORDS and len(y) >= MIN_WORDS and jaccard_reached(x, y):
                out.append((k1, s1, k2, s2))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string()) * 2)], names=["ka", "sa", "kb", "sb"])


def class_pairs(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """Alike pairs of different texts.

    texts: distinct (k bigint, stem string), k = xxhash64(stem). Gives (ka, sa, kb, sb), each pair once.
    """
    spark = texts.sparkSession
    parts = parts or max(shuffle_partitions(spark), -(-texts.count() * BANDS // PART_ROWS))
    packed = texts.select("k", "stem").mapInArrow(_emit(parts), "part int, rows binary")
    found = written(packed.repartitionById(parts, F.col("part")).mapInArrow(_compare, _FOUND), "p1")
    direct = found.where("block is null").select("a", "b")
    # every block meets every block of its bucket once: both go to the pair's key
    roles = found.where("block is not null").select("bucket", "i", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("j"))
    met = roles.groupBy("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.collect_list("block").alias("blocks"))
    large = met.select("blocks").mapInArrow(_compare_blocks, "a long, b long")
    pairs = direct.unionByName(large).distinct()
    one = texts.select(F.col("k").alias("a"), F.col("stem").alias("sa"))
    two = texts.select(F.col("k").alias("b"), F.col("stem").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select(F.col("a").alias("ka"), "sa", F.col("b").alias("kb"), "sb").mapInArrow(_verify, "ka long, sa string, kb long, sb string")


def stems(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, k, stem), one row per id and stem; and the distinct (k, stem)."""
    ids = questions.where("id is not null and stem is not null").select("id", F.xxhash64("stem").alias("k"), "stem")
    return ids.select("id", "k", "stem").dropDuplicates(["id", "k", "stem"]), ids.select("k", "stem").dropDuplicates(["k", "stem"])


def alike_ids(questions: DataFrame) -> DataFrame:
    """p1_found's rows: (id_a, id_b), smaller id first, for different ids with alike stems."""
    spark = questions.sparkSession
    ids, texts = stems(questions)
    texts = written(texts, "p1-texts")
    pairs = class_pairs(texts)
    # members of the classes by a digest of the text, so that the expansion moves no texts
    member = ids.select("id", F.md5("stem").alias("c"), "stem")
    ends = pairs.select(F.md5("sa").alias("ca"), F.md5("sb").alias("cb"))
    slim = member.select("id", "c")
    across = ends.join(slim.select(F.col("id").alias("x"), F.col("c").alias("ca")), "ca").join(slim.select(F.col("id").alias("y"), F.col("c").alias("cb")), "cb").select("x", "y")
    # copies of one text: only classes of two ids or more are joined with themselves
    shared = member.groupBy("c").agg(F.count("*").alias("n"), F.any_value("stem").alias("stem")).where("n > 1")
    shared = shared.mapInArrow(_long_enough, "c string")
    copies = slim.join(shared, "c", "left_semi")
    within = copies.select("c", F.col("id").alias("x")).join(copies.select("c", F.col("id").alias("y")), "c").where("x < y").select("x", "y")
    return across.where("x <> y").unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _long_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c, s = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("c", "stem"))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, t in zip(c, s) if len(words_of(t)) >= MIN_WORDS], pa.string())], names=["c"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of (ka, kb): (node, root), root the least node. Alternating large and small stars
    over pre-aggregated minima; every round is written, so lineage stays short and lost executors cost one round."""
    spark = edges.sparkSession
    e = written(edges.select(F.greatest("ka", "kb").alias("u"), F.least("ka", "kb").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(own, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, written(small, "cc")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.join(e.select(F.col("u").alias("node")), "node", "left_anti"))


def groups(questions: DataFrame) -> DataFrame:
    """One row per id and text: its class (copies of one text), the number of alike classes, its group."""
    ids, texts = stems(questions)
    texts = written(texts, "p1-texts")
    pairs = written(class_pairs(texts).select("ka", "kb"), "p1-pairs")
    links = pairs.select(F.col("ka").alias("k")).unionByName(pairs.select(F.col("kb").alias("k"))).groupBy("k").agg(F.count("*").alias("n_links"))
    root = components(pairs).select(F.col("node").alias("k"), "root")
    return (
        ids.select("id", "k")
        .join(links, "k", "left")
        .join(root, "k", "left")
        .select("id", F.col("k").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "k").alias("group_id"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_ids(table(spark, sf_dir, "question").select("id", "stem"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "question").select("id", "stem"))
