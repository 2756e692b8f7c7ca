import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.operators import clusters, images

BOX = "doc_id int, page int, name string, bbox array<double>"
FIVE = [
    (1, 5, "p005_eq000.png", [100.0, 100.0, 200.0, 150.0]), (1, 5, "p005_eq001.png", [100.5, 100.2, 200.4, 150.1]), (1, 6, "p006_eq000.png", [100.0, 100.0, 200.0, 150.0]),
    (1, 5, "p005_eq002.png", [120.0, 110.0, 150.0, 130.0]), (1, 5, "p005_eq003.png", [400.0, 100.0, 500.0, 150.0]),
]


def test_only_same_page_near_identical_boxes_alias(spark):
    got = [(r.name, r.alias_of) for r in images.aliases(spark.createDataFrame(FIVE, BOX)).collect()]
    assert got == [("p005_eq001.png", "p005_eq000.png")]


def test_alias_is_never_a_target_and_bad_boxes_are_ignored(spark):
    rows = [(1, 1, f"p001_eq{i:03d}.png", [10.0 + i * 1.5, 10.0, 210.0 + i * 1.5, 110.0]) for i in range(3)]
    rows += [(1, 1, "p001_eq008.png", None), (1, 1, "p001_eq009.png", [5.0, 5.0, 5.0, 9.0]), (1, 1, "manual_000.png", [10.0, 10.0, 210.0, 110.0]), (1, 1, "p001_eq010.png", [None, 1.0, 2.0, 3.0])]
    got = {(r.name, r.alias_of) for r in images.aliases(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {("p001_eq001.png", "p001_eq000.png")}  # 2 is near 1, but 1 is an alias
    assert images.aliases(spark.createDataFrame([], BOX)).count() == 0


def test_aliases_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(3):
        base = rng.uniform(0, 300, (8, 2))
        for i in range(40):
            x, y = base[rng.integers(8)] + rng.uniform(-1.2, 1.2, 2)
            rows.append((1, p, f"p{p:03d}_eq{i:03d}.png", [float(x), float(y), float(x + 100), float(y + 60)]))

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / (12000 - i)

    want = set()
    for p in range(3):
        kept = []
        for _, _, n, b in [r for r in rows if r[1] == p]:
            hit = next((k for k, c in kept if max(abs(x - y) for x, y in zip(b, c)) <= 2 and iou(b, c) >= 0.9), None)
            if hit:
                want.add((p, n, hit))
            else:
                kept.append((n, b))
    got = {(r.page, r.name, r.alias_of) for r in images.aliases(spark.createDataFrame(rows, BOX)).collect()}
    assert got == want


def test_dedup_of_sections_is_idempotent(spark):
    alias = images.aliases(spark.createDataFrame(FIVE, BOX))
    sec = spark.createDataFrame([(1, "a", "x [[eq:p005_eq000.png]] [[eq:p005_eq001.png]]"), (1, "b", "[[eq:p005_eq001.png]]"), (1, "c", None)], "doc_id int, key string, text string")
    once = images.without_aliases(sec, alias)
    assert {r.key: r.text for r in once.collect()} == {"a": "x [[eq:p005_eq000.png]] ", "b": "[[eq:p005_eq001.png]]", "c": None}
    assert images.without_aliases(once.drop("dropped"), alias).agg(F.sum("dropped")).first()[0] == 0
    refs = images.rewritten_refs(sec.select("key", "text"), alias.select("name", "alias_of"))
    assert {r.key: r.text for r in refs.collect()}["b"] == "[[eq:p005_eq000.png]]"


def test_removal_and_results(spark):
    sec = spark.createDataFrame([(1, "a", "x [[eq:n.png]]  y"), (2, "a", "[[eq:n.png]]")], "doc_id int, key string, text string")
    gone = spark.createDataFrame([(1, "n.png")], "doc_id int, name string")
    assert {r.doc_id: (r.text, r.removed) for r in images.without_images(sec, gone).collect()} == {1: ("x y", 1), 2: ("[[eq:n.png]]", 0)}
    r = spark.createDataFrame([(1, "a", "n.png", "old", "model", True), (1, "b", "n.png", None, "scan", True), (1, "b", "m.png", "q", "model", True)], "doc_id int, key string, name string, latex string, source string, needs_review boolean")
    res = spark.createDataFrame([(1, "n.png", "x", "ai")], "doc_id int, name string, latex string, source string")
    got = {(x.key, x.name): (x.latex, x.source, x.needs_review) for x in images.with_result(r, res).collect()}
    assert got == {("a", "n.png"): ("x", "ai", False), ("b", "n.png"): ("x", "ai", False), ("b", "m.png"): ("q", "model", True)}
    assert [x.name for x in images.next_manual_name(spark.createDataFrame([(1, "manual_004.png"), (1, "p001_eq1.png")], "doc_id int, name string")).collect()] == ["manual_005.png"]


def test_cascade_model_and_validation(spark):
    f = spark.createDataFrame(
        [("a", "1", 50.0, 20.0, None, False, "x", 0.9, "m"), ("b", "1", 50.0, 20.0, None, False, "x", 0.9, "m"), ("c", "2", 200.0, 300.0, None, False, "x", 0.9, "t"), ("d", "3", 200.0, 30.0, "coloured", True, None, None, None),
         ("e", "4", 200.0, 30.0, None, True, None, None, "m"), ("f", "5", 200.0, 30.0, None, False, None, None, None)],
        "name string, md5 string, width double, height double, figure_reason string, is_scan boolean, glyph string, glyph_score double, model_latex string",
    )
    got = {r.name: (r.source, r.latex, r.needs_review) for r in images.recognise(f).collect()}
    assert got == {"a": ("glyph", "x", False), "b": ("glyph", "x", False), "c": ("model", "t", True), "d": ("figure", None, False), "e": ("scan", None, True), "f": ("model", None, True)}

    def model(items):
        if len(items) > 1:
            raise MemoryError
        return [None if items[0] == b"bad" else items[0].decode()]

    crops = spark.createDataFrame([("1", "s", bytearray(b"aa")), ("2", "s", bytearray(b"bad")), ("1", "s", bytearray(b"aa"))], "md5 string, shape string, content binary")
    assert {r.md5: r.model_latex for r in images.with_model(crops, model).collect()} == {"1": "aa", "2": None}
    rd = spark.createDataFrame([("x", "{a", False), ("y", "{a}", False), ("z", "{a", True), ("w", None, None)], "name string, latex string, needs_review boolean")
    assert {r.name: r.needs_review for r in images.validated(rd).collect()} == {"x": True, "y": False, "z": True, "w": False}


def test_geometry(spark):
    d = spark.createDataFrame([([10.02, 20.0, 100.02, 40.0],), (None,), ([-5.0, 0.0, 700.0, 900.0],)], "b array<double>")
    got = [r.n for r in d.select(G.normalised("b", F.lit(600.0), F.lit(800.0)).alias("n")).collect()]
    assert got[0] == pytest.approx([0.0167, 0.025, 0.1667, 0.05]) and got[1] is None and got[2] == [0.0, 0.0, 1.0, 1.0]
    s = spark.createDataFrame([([0.02, 0.03, 0.2, 0.08],), ([0.1, 0.1, 0.1, 0.2],), ([0.1, float("nan"), 0.3, 0.2],), ([0.0, 0.0, 1.2, 1.0],), (None,)], "b array<double>")
    assert [r.v for r in s.select(G.valid_selection("b", F.lit(600.0), F.lit(800.0)).alias("v")).collect()] == [True, False, False, False, False]
    assert s.select(G.in_points("b", F.lit(600.0), F.lit(800.0)).alias("p")).first().p == pytest.approx([12, 24, 120, 64])


def test_figures_inside(spark):
    sel = spark.createDataFrame([("s", 1, 1, [0.0, 0.0, 50.0, 50.0])], "sel_id string, doc_id int, page int, area array<double>")
    b = spark.createDataFrame([(1, 1, "in", [10.0, 10.0, 60.0, 60.0]), (1, 1, "out", [60.0, 60.0, 90.0, 90.0]), (1, 2, "other", [10.0, 10.0, 20.0, 20.0]), (1, 1, "none", None)], BOX)
    assert [r.name for r in images.figures_in(sel, b).collect()] == ["in"]


def test_clusters_grow_to_a_fixpoint(spark):
    rows = [(1, 1, "a", [0.0, 0.0, 10.0, 10.0]), (1, 1, "b", [40.0, 0.0, 50.0, 10.0]), (1, 1, "c", [5.0, 15.0, 45.0, 20.0]), (1, 1, "d", [300.0, 300.0, 310.0, 310.0]), (1, 1, "e", None)]
    got = [(r.cluster, r.n, r.x0, r.bottom) for r in clusters.drawings(spark.createDataFrame(rows, BOX)).orderBy("cluster").collect()]
    assert got == [(0, 3, 0.0, 20.0), (1, 1, 300.0, 310.0)]
    w = spark.createDataFrame([(1, 1, "CH3", 52.0, 2.0, 70.0, 9.0), (1, 1, "(A)", 20.0, 22.0, 30.0, 28.0), (1, 1, "a long word that is prose", 52.0, 2.0, 190.0, 9.0)], "doc_id int, page int, text string, x0 double, top double, x1 double, bottom double")
    g = clusters.with_labels(clusters.drawings(spark.createDataFrame(rows, BOX)), w).orderBy("cluster").first()
    assert (g.x0, g.top, g.x1, g.bottom) == (0.0, 0.0, 70.0, 20.0)


def test_symbols_and_ink():
    def draw(rows):
        return np.array([[c == "#" for c in r] for r in rows])

    bar, box = draw(["##"] * 12), np.pad(draw(["#" * 12] * 3 + ["###......###".replace(".", " ")] * 6 + ["#" * 12] * 3), 0)
    t = [("1", *clusters.normalised(bar)), ("0", *clusters.normalised(box))]
    assert clusters.classify(bar, t)[0] == "1" and clusters.classify(box, t)[0] == "0"
    two = np.concatenate([np.pad(bar, ((0, 0), (0, 3))), box], axis=1)
    assert clusters.classify(two, t)[0] == "10"
    assert clusters.classify(np.zeros((5, 5), bool), t) == ("", 1.0)
    assert clusters.join_scripts([("inline", "f"), ("sup", "-"), ("sup", "1"), ("inline", r"\in"), ("inline", "R")]) == r"f^{-1}\in R"
    ink = np.zeros((400, 400), bool)
    ink[200:215, 50:90] = True
    ink[200:215, 95:130] = True
    ink[300, 300] = True
    assert clusters.regions_of_ink(ink) == [(33, 195, 147, 220)]
    rgb = np.full((200, 300, 3), 255, np.uint8)
    assert clusters.figure_reason(rgb) is None
    rgb[50:52, 20:290] = 0
    rgb[20:190, 50:52] = 0
    assert "lines" in clusters.figure_reason(rgb)
    rgb[:100, :100, 0] = 10
    assert "coloured" in clusters.figure_reason(rgb)
