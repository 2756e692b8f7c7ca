import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.llm import near_dup as N


def made(seed=5, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = rng.sample(vocab, rng.randint(14, 40))
        rows.append((f"b{i:03d}", " ".join(base)))
        for k in range(rng.randint(0, 3)):
            w = base[:]
            for _ in range(rng.randint(0, len(w) // 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rng.shuffle(w)
            rows.append((f"v{i:03d}{k}", "(" + " ".join(w).capitalize() + ")."))
    return rows


def brute(rows):
    s = [(i, N.words_of(t)) for i, t in rows if i and t]
    return {tuple(sorted((a, b))) for x, (a, p) in enumerate(s) for b, q in s[x + 1 :] if a != b and len(p) >= 12 and len(q) >= 12 and len(p & q) >= 0.75 * len(p | q)}


def test_pairs_against_brute_force_with_dirty_rows(spark):
    rows = made()
    rows += [rows[0], ("copy1", rows[3][1]), ("copy2", rows[3][1]), ("short1", "one two three"), ("short2", "one two three"), ("none", None), (None, rows[0][1]), ("empty", ""), ("two", rows[4][1]), ("two", rows[9][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id string, stem string, k string, n int")
    got = [(r.id_a, r.id_b) for r in N.alike_ids(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 60


def test_groups(spark):
    rows = made(7, 60) + [("copy", made(7, 60)[0][1])]
    got = {r.id: r for r in N.groups(spark.createDataFrame(rows, "id string, stem string")).collect()}
    link = brute(rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in link:
        root[find(a)] = find(b)
    for a in got:
        for b in got:
            assert (got[a].group_id == got[b].group_id) == (find(a) == find(b))
    text = dict(rows)
    for a in got:
        others = {text[y] if x == a else text[x] for x, y in link if a in (x, y)} - {text[a]}
        assert got[a].n_links == len(others)
    assert got["copy"].class_id == got["b000"].class_id


def test_empty_and_long(spark):
    e = spark.createDataFrame([], "id string, stem string")
    assert N.alike_ids(e).count() == 0 and N.groups(e).count() == 0
    long = " ".join(f"x{i}" for i in range(60_000))
    d = spark.createDataFrame([("a", long), ("b", long + " y"), ("c", "z " * 50_000)], "id string, stem string")
    assert [(r.id_a, r.id_b) for r in N.alike_ids(d).collect()] == [("a", "b")]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "ka long, kb long")
    got = {r.node: r.root for r in N.components(e).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43


def test_oversized_buckets_go_through_blocks(monkeypatch):
    base = {f"w{i}" for i in range(40)}
    sets = [base | {f"own{k}"} for k in range(40)]
    sig = N.signatures(sets)
    rows = np.empty(40, dtype=N._ROW)
    rows["key"], rows["doc"], rows["n"] = 1, np.arange(40), 41
    rows["sig"] = np.packbits((sig[:, : 64 * N.SIG_WORDS] & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "rows"])

    def pairs(batches):
        return {p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p[0] is not None}

    whole = pairs(N._compare(iter([batch])))
    monkeypatch.setattr(N, "BLOCK", 7)
    cut = list(N._compare(iter([batch])))
    own = [(b.column(2)[0].as_py(), b.column(3)[0].as_py(), b.column(5)[0].as_py()) for b in cut if b.num_rows and b.column(5).null_count == 0]
    assert len(own) == 6 and {b for b, _, _ in own} == {1} and [i for _, i, _ in own] == list(range(6))
    met = [[own[i][2]] if i == j else [own[i][2], own[j][2]] for i in range(6) for j in range(i, 6)]
    blocks = [pa.RecordBatch.from_arrays([pa.array([m], pa.list_(pa.binary()))], names=["blocks"]) for m in met]
    assert len(whole) == 40 * 39 // 2 and pairs(N._compare_blocks(iter(blocks))) == whole


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"id{k:02d}", f"{base} own{k}") for k in range(40)] + [(f"far{k}", " ".join(f"f{k}x{i}" for i in range(15))) for k in range(30)]
    d = spark.createDataFrame(rows, "id string, stem string")
    whole = {tuple(r) for r in N.alike_ids(d).collect()}
    assert len(whole) == 40 * 39 // 2
    for name, value in (("BLOCK", 9), ("GATHER", 5), ("PART_ROWS", 40)):
        monkeypatch.setattr(N, name, value)
        assert {tuple(r) for r in N.alike_ids(d).collect()} == whole


def test_pruning_keeps_pairs_at_the_threshold():
    need = N.least_matches(128)
    p = (1 + N.THRESHOLD) / 2
    rng = np.random.default_rng(1)
    assert (rng.binomial(128, p, 100_000) < need).mean() < 2e-3 and (rng.binomial(128, 0.6, 100_000) >= need).mean() < 2e-3


def test_whole_table_query_is_registered(spark):
    from quillmark.llm.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and all(any(q.startswith(f"p{n}_") for q in QUERIES) for n in range(1, 9))
    assert F is not None
