"""Problem 6: texts packed into containers of fixed capacity (best-two-fit).

Texts are sized once in tokens of a public tokenizer. A text longer than a container is cut into full pieces and a
rest; nothing else is cut. Items go by a hash of their id into shards of about ``SHARD_TOKENS`` tokens and at most about
``SHARD_DOCS`` texts, so that no task grows with the data and no source or size is hot; every shard is packed on its
own, which costs at most one partly filled container a shard.

Within a shard a container is filled greedily with the largest item that fits. If a gap is left, its smallest item
gives way to two unpacked items that fit the widened gap more tightly, if there are such. Items of one size are
interchangeable, so the search runs over distinct sizes only. Where greedy filling alone needs fewer containers for a
shard, its packing is kept (the compound of best-two-fit and a decreasing-size filling that Friesen and Langston
analysed in 1991: either is best on other mixes of sizes).

Cases: null texts count as empty; empty texts take no room and stand in their shard's first container; capacities that
are null or below one are left out; a table without documents gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.runtime import table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern this vocabulary was made with (published with it), as a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS, SHARD_DOCS = 4_000_000, 50_000
#: Characters encoded in one call; longer texts are cut at white space, where the pattern never joins words.
PIECE = 200_000
#: A run of white space as long as this is encoded without the pattern, which cannot take it whole.
BLANKS = 4096

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _cuts(text: str) -> Iterator[str]:
    """A very long text in pieces that encode as the whole does: cut between a word and the space before the next."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at + 1 and not (text[end] == " " and text[end - 1].isalnum() and end + 1 < len(text) and text[end + 1].isalnum()):
            end -= 1
        if end <= at + 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


_LONG_BLANK = re.compile(rf"\s{{{BLANKS},}}")


def _tokens(enc, text: str) -> int:
    return sum(len(enc.encode_ordinary(p)) for p in _cuts(text))


def _count(enc, text: str) -> int:
    """Tokens of the whole text. The pattern takes a run of white space as one piece, but for its last character where
    text follows: that one goes with the next word, or is a piece of its own."""
    n = at = 0
    for m in _LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += _tokens(enc, text[at : m.start()]) + len(enc._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + _tokens(enc, text[at:])


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    enc = encoder(path)
    return [_count(enc, t) if t else 0 for t in texts]


def _size(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens)"""
    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(_size(tokenizer), "doc_id bigint, n_tokens bigint")


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each container; every size is from 1 to the capacity.

    The better of best-two-fit and its greedy filling alone (the compound rule: each is best on other mixes of sizes)."""
    two, plain = _pack(sizes, capacity, True), _pack(sizes, capacity, False)
    return two if len(two) <= len(plain) else plain


def _pack(sizes: list[int], capacity: int, exchange: bool) -> list[list[int]]:
    stock: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stock.setdefault(sizes[i], []).append(i)
    free = sorted(stock)  # distinct sizes still unpacked

    def take(size: int) -> int:
        i = stock[size].pop()
        if not stock[size]:
            del stock[size]
            del free[bisect_left(free, size)]
        return i

    def give(size: int, i: int) -> None:
        if size in stock:
            stock[size].append(i)
        else:
            stock[size] = [i]
            insort(free, size)

    out = []
    while free:
        room, items = capacity, []
        while free and (k := bisect_right(free, room)):
            size = free[k - 1]
            items.append((size, take(size)))
            room -= size
        while exchange and room and free:
            small, at = min((s, n) for n, (s, _) in enumerate(items))
            pair = _two(free, stock, small, room + small)
            if pair is None:
                break
            a, b = pair
            _, back = items.pop(at)
            items += [(a, take(a)), (b, take(b))]
            give(small, back)
            room += small - a - b
        out.append([i for _, i in items])
    return out


def _two(free: list[int], stock: dict[int, list[int]], above: int, room: int) -> tuple[int, int] | None:
    """Two unpacked sizes whose sum is the largest of those over ``above`` and up to ``room``."""
    best, found = above, None
    lo, hi = 0, bisect_right(free, room) - 1
    while lo <= hi:
        total = free[lo] + free[hi]
        if total > room or (lo == hi and len(stock[free[lo]]) < 2):
            hi -= 1
            continue
        if total > best:
            best, found = total, (free[lo], free[hi])
            if total == room:
                break
        lo += 1
    return found


_SCHEMA = "capacity_id int, capacity int, doc_id bigint, piece int, token_from bigint, piece_tokens int, container string"


def _pack_shard(t: pa.Table) -> pa.Table:
    cap_id, cap, shard = (t.column(c)[0].as_py() for c in ("capacity_id", "capacity", "shard"))
    rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("n_tokens").to_pylist()))
    docs, piece, start, size, empty = [], [], [], [], []
    for d, n in rows:
        if n == 0:
            empty.append(d)
        for p, at in enumerate(range(0, n, cap)):
            docs.append(d)
            piece.append(p)
            start.append(at)
            size.append(min(cap, n - at))
    bins = pack(size, cap)
    of = [0] * len(docs)
    for k, items in enumerate(bins):
        for i in items:
            of[i] = k
    docs += empty
    piece += [0] * len(empty)
    start += [0] * len(empty)
    size += [0] * len(empty)
    of += [0] * len(empty)
    n = len(docs)
    return pa.table(
        {
            "capacity_id": pa.array([cap_id] * n, pa.int32()),
            "capacity": pa.array([cap] * n, pa.int32()),
            "doc_id": pa.array(docs, pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "token_from": pa.array(start, pa.int64()),
            "piece_tokens": pa.array(size, pa.int32()),
            "container": pa.array([f"{cap_id}-{shard}-{k}" for k in of], pa.string()),
        }
    )


def packed(documents: DataFrame, capacities: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per text (or piece of an oversized text) and capacity: the container it is in."""
    tokenizer = tokenizer or os.environ.get("QUILLMARK_TOKENIZER", TOKENIZER)
    sizes = written(sized(documents, tokenizer), "p6-sizes")
    total, docs = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // SHARD_TOKENS), -(-docs // SHARD_DOCS))
    # a list of container sizes is a parameter: every size packs all documents anew
    caps = capacities.where("n_tokens >= 1 and capacity_id is not null").select("capacity_id", F.col("n_tokens").cast("int").alias("capacity")).distinct()
    wanted = [F.struct(F.lit(r.capacity_id).alias("capacity_id"), F.lit(r.capacity).alias("capacity")) for r in caps.toLocalIterator()]
    if not wanted:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    items = sizes.select("doc_id", "n_tokens", shard, F.explode(F.array(*wanted)).alias("c")).select("doc_id", "n_tokens", "shard", "c.capacity_id", "c.capacity")
    return items.groupBy("capacity_id", "capacity", "shard").applyInArrow(_pack_shard, _SCHEMA)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens in them, share of the room that is used."""
    c = p6_packed(spark, sf_dir).groupBy("capacity_id", "capacity", "container").agg(F.sum("piece_tokens").cast("bigint").alias("used"))
    return c.groupBy("capacity_id", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
