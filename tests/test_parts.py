import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import clusters, lines, parts, review, selections, sets, syllabus
from quillmark.operators import rollups as R
from quillmark.sources import documents as D

PART = "doc_id int, key string, part string, text string, equations array<string>, extra int"
READ = "doc_id int, key string, part string, name string, latex string, source string, needs_review boolean"
TEXT = "a [[eq:p001_eq000.png]] b [[eq:p001_eq001.png]]"


@pytest.fixture(scope="module")
def page(spark):
    p = spark.createDataFrame([(1, "0-0", "question", TEXT, ["p001_eq000.png", "p001_eq001.png"], 1), (1, "0-0", "solution", "only [[eq:p001_eq001.png]]", ["p001_eq001.png"], 1), (2, "0-0", "question", "", [], 1), (3, "0-0", "question", None, None, 1)], PART)
    r = spark.createDataFrame([(1, "0-0", "question", "p001_eq000.png", "x", "model", False), (1, "0-0", "question", "p001_eq001.png", "y", "skipped", True), (1, "0-0", "solution", "p001_eq001.png", None, "figure", False)], READ)
    return p, r


def at(df, *cols):
    return {(r.doc_id, r.part): tuple(r[c] for c in cols) for r in df.collect()}


def test_aliases_leave_only_where_the_original_stands(spark, page):
    a = spark.createDataFrame([(1, "p001_eq001.png", "p001_eq000.png")], "doc_id int, name string, alias_of string")
    p, r, dropped = parts.deduplicated(*page, a)
    got = at(p, "text", "equations")
    assert got[1, "question"] == ("a [[eq:p001_eq000.png]] b ", ["p001_eq000.png"]) and got[1, "solution"] == ("only [[eq:p001_eq001.png]]", ["p001_eq001.png"]) and got[3, "question"] == (None, None)
    assert sorted(x.name for x in r.collect()) == ["p001_eq000.png", "p001_eq001.png"] and [tuple(x) for x in dropped.collect()] == [(1, "p001_eq001.png", "p001_eq000.png")]
    again, _, more = parts.deduplicated(p, r, a)
    assert at(again, "text", "equations") == got and more.count() == 0
    assert parts.deduplicated(*page, a.limit(0))[2].count() == 0


def test_removal_squeezes_and_logs(spark, page):
    gone = spark.createDataFrame([(1, "p001_eq001.png"), (1, "p001_eq001.png"), (9, "none.png")], "doc_id int, name string")
    p, r, log = parts.removed(*page, gone)
    got = at(p, "text", "equations")
    assert got[1, "question"] == ("a [[eq:p001_eq000.png]] b", ["p001_eq000.png"]) and got[1, "solution"] == ("only", []) and got[2, "question"] == ("", [])
    assert r.count() == 1 and [tuple(x) for x in log.collect()] == [(1, "p001_eq001.png", 2)]


def test_actions_on_pictures(spark, page):
    acts = spark.createDataFrame([(1, "p001_eq000.png", "ai", "z"), (1, "p001_eq001.png", "remove", None), (7, "none.png", "skip", None)], "doc_id int, name string, action string, latex string")
    over = spark.createDataFrame([(1, "0-0", "question", "see ![](img:p001_eq000.png) and ![](img:p001_eq001.png) "), (1, "0-0", "solution", " untouched "), (2, "0-0", "question", None)], "doc_id int, key string, part string, text string")
    p, r, o, log = parts.acted(*page, over, acts)
    assert at(p, "text")[1, "solution"] == ("only",) and [(x.latex, x.source) for x in r.collect()] == [("z", "ai")]
    assert at(o, "text") == {(1, "question"): (r"see \(z\) and",), (1, "solution"): (" untouched ",), (2, "question"): (None,)}
    assert {(x.name, x.action, x.occurrences) for x in log.collect()} == {("p001_eq000.png", "ai", 1), ("p001_eq001.png", "remove", 2)}


def test_reset_carry_and_anchors(spark, page):
    f = spark.createDataFrame([(1, "p001_eq000.png", "coloured"), (1, "p001_eq001.png", "coloured"), (1, "p001_eq001.png", None)], "doc_id int, name string, reason string")
    got = {(r.part, r.name): (r.latex, r.source) for r in parts.reclassified(page[1], f).collect()}
    assert got == {("question", "p001_eq000.png"): (None, "figure"), ("question", "p001_eq001.png"): ("y", "skipped"), ("solution", "p001_eq001.png"): (None, "figure")}
    carried = {(r.part, r.name): r.latex for r in parts.readings_carried(page[0], page[1]).collect()}
    assert carried == {("question", "p001_eq000.png"): "x", ("question", "p001_eq001.png"): None, ("solution", "p001_eq001.png"): None}
    assert {(r.part, r.pos): (r.anchor, r.before, r.trailing) for r in parts.figure_anchors(page[0]).collect()} == {("question", 0): ("a", 1, False), ("question", 1): ("b", 2, True), ("solution", 0): ("only", 1, True)}
    e = spark.createDataFrame([(1, "x\nAdditional exercises \ny"), (2, "Question A3: x"), (3, "see Additional Exercises"), (4, None)], "doc_id int, text string")
    assert {r.doc_id: r.embedded for r in parts.embedded_additional(e).collect()} == {1: True, 2: True, 3: False, 4: False}
    d = spark.createDataFrame([(1, [], ["p1_ocr000.png"]), (2, [3], None), (3, None, None), (4, [], ["a"])], "doc_id int, scanned_pages array<int>, names array<string>")
    assert {r.doc_id: r.scanned for r in parts.with_scans(d).collect()} == {1: True, 2: True, 3: False, 4: False}


def sections(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, exercise bigint, title string, question bigint, label string, number int, page_start int, heading string, question_text string, solution_text string, lines bigint")


def brute_remap(old, new):
    out, used = {}, set()
    sig = {"a": lambda r: (r[4].upper(), r[6], r[8][:160]), "b": lambda r: (r[4].upper(), r[6]), "c": lambda r: (r[2], r[4].upper(), r[8][:160]), "d": lambda r: (r[2], r[4].upper())}
    for f in sig.values():
        for o in sorted(old, key=lambda r: (r[1], r[3])):
            k = f"{o[1]}-{o[3]}"
            free = [f"{n[1]}-{n[3]}" for n in new if f(n) == f(o) and f"{n[1]}-{n[3]}" not in used]
            if k not in out and len(free) == 1:
                out[k] = free[0]
                used.add(free[0])
    return out


def test_remap_against_the_row_by_row_rule(spark):
    rng = random.Random(4)
    make = lambda doc: [(doc, e, rng.choice(["E 1", "E 2"]), q, rng.choice(["1", "2", "a1"]), 1, rng.choice([1, 2]), None, rng.choice(["s", "t", "u"]), "", 1) for e in range(3) for q in range(rng.randint(0, 4))]
    old, new = {d: make(d) for d in range(12)}, {d: make(d) for d in range(12)}
    flat = lambda x: [r for rows in x.values() for r in rows]
    got: dict = {d: {} for d in range(12)}
    for r in review.remap(sections(spark, flat(old)), sections(spark, flat(new))).collect():
        got[r.doc_id][r.old_key] = r.new_key
    assert got == {d: brute_remap(old[d], new[d]) for d in range(12)} and any(got.values())
    assert review.remap(sections(spark, flat(old)[:0]), sections(spark, flat(new))).count() == 0


def test_migration_on_reading(spark):
    old = [(d, 0, "E 1", q, str(q + 1), q + 1, 1, None, f"stem {q}" + ("\nQuestion A1: x" if d == 2 else ""), "", 1) for d in (1, 2, 3, 4) for q in (0, 1)]
    new = [(d, 5, "E 1", q, str(q + 1), q + 1, 1, None, f"stem {q}", "", 1) for d in (1, 2, 3, 4) for q in (0,)]
    docs = spark.createDataFrame([(1, 7), (2, 7), (3, 6), (4, 8), (5, None)], "doc_id int, version int")
    edits = spark.createDataFrame([(d, k, "e") for d in (1, 2, 3, 4) for k in ("0-0", "0-1", "add-x")], "doc_id int, key string, edit string")
    ds, qs, kept, lost = parts.migrated(docs, sections(spark, old), sections(spark, new), edits, 8)
    assert {(r.doc_id, r.version, r.split_again) for r in ds.collect()} == {(1, 8, False), (2, 8, True), (3, 8, True), (4, 8, False), (5, 8, True)}
    assert {(r.doc_id, r.key) for r in kept.collect()} == {(d, k) for d in (1, 4) for k in ("0-0", "0-1", "add-x")} | {(d, k) for d in (2, 3) for k in ("5-0", "add-x")}
    assert {(r.doc_id, r.orphan) for r in lost.collect()} == {(2, "E 1|2|0-1"), (3, "E 1|2|0-1")} and qs.count() == 6


def test_crops_are_numbered_on_and_appended(spark):
    texts = spark.createDataFrame([(1, "k", "question", "edited \n", "auto"), (1, "k", "solution", None, None)], "doc_id int, key string, part string, override string, auto string")
    crops = spark.createDataFrame([(1, "k", "question", 2, [0.5, 0.5, 0.1, 0.1], "b"), (1, "k", "question", 1, [0.1, 0.1, 0.2, 0.2], "a"), (1, "k", "solution", 1, [0.0, 0.0, 1.0, 1.0], "c"), (1, "k", "question", 1, [0.1, 0.1, 0.101, 0.2], "d"), (1, "z", "question", 1, [0.1, 0.1, 0.2, 0.2], "e"), (1, "k", "question", 1, [0.1, None, 0.2, 0.2], "f"), (1, "k", "question", 1, None, "g")], "doc_id int, key string, part string, page int, area array<double>, pos string")
    taken = spark.createDataFrame([(1, "manual_004.png"), (1, "p001_eq000.png"), (2, "manual_900.png")], "doc_id int, name string")
    pics, changed = selections.cropped(crops, texts, taken)
    got = {(r.name, r.error): r.bbox for r in pics.collect() if r.name}
    assert got["manual_006.png", None] == [61.2, 79.2, 306.0, 396.0] and len(got) == 3
    assert sorted(r.error for r in pics.collect() if r.error) == ["not an area", "not an area", "too small", "unknown question"]
    assert at(changed, "text") == {(1, "question"): ("edited\n![](img:manual_005.png)\n![](img:manual_006.png)",), (1, "solution"): ("![](img:manual_007.png)",)}


def test_areas_read_into_a_part(spark):
    area = "array<struct<page:int,area:array<double>>>"
    whole, tiny = (1, [0.1, 0.2, 0.8, 0.8]), (1, [0.1, 0.1, 0.102, 0.5])
    reqs = [("ok", "question", [whole, (2, [0.1, 0.1, 0.7, 0.4])]), ("none", "question", []), ("null", "question", None), ("page", "question", [(9, [0.1, 0.1, 0.7, 0.4])]), ("tiny", "question", [whole, tiny]), ("many", "question", [whole] * 9), ("part", "answer", [whole]), ("blank", "question", [whole]), ("ink", "solution", [whole])]
    r = spark.createDataFrame([(i, 1, "k", p, a) for i, p, a in reqs], f"req_id string, doc_id int, key string, part string, areas {area}")
    sizes = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id int, page int, width double, height double")
    plan = selections.planned(r, sizes)
    got = {x.req_id: x for x in plan.collect()}
    assert [tuple(a.bbox) for a in got["ok"].areas] == [(60.0, 160.0, 480.0, 640.0), (60.0, 80.0, 420.0, 320.0)]
    assert {k: v.error for k, v in got.items()} == {"ok": None, "none": "no area", "null": "no area", "page": "no such page", "tiny": "too small", "many": "too many areas", "part": "choose question or solution", "blank": None, "ink": None}
    figs = selections.figures_selected(plan, spark.createDataFrame([(1, "f1.png", 1, [100.0, 200.0, 200.0, 300.0], "2"), (1, "f0.png", 2, [100.0, 90.0, 200.0, 200.0], "1"), (1, "out.png", 1, [0.0, 0.0, 20.0, 20.0], "0"), (1, "nul.png", 1, None, "3")], "doc_id int, name string, page int, bbox array<double>, pos string"))
    assert {x.req_id: x.figures for x in figs.collect()}["ok"] == ["f0.png", "f1.png"]
    answers = spark.createDataFrame([("ok", "first $x$\n[[FIGURE]]", " second ", 9, 9), ("blank", " ", "", 10, 1000), ("ink", "", None, 900, 1000)], "req_id string, question string, solution string, dark int, pixels int")
    texts = spark.createDataFrame([(1, "k", "question", "first x\n![](img:f1.png)\nmore"), (1, "k", "solution", "old")], "doc_id int, key string, part string, text string")
    out = {x.req_id: x for x in selections.extracted(plan, answers, texts, figs.where("req_id = 'ok'"), spark.createDataFrame([(1, "manual_002.png")], "doc_id int, name string")).collect()}
    assert out["ok"].text == "first \\(x\\)\n![](img:f1.png)\n![](img:f0.png)\nsecond"
    assert out["blank"].error == "the area is blank" and out["blank"].text is None and out["ink"].text == "![](img:manual_003.png)" and out["ink"].new_names == ["manual_003.png"] and out["tiny"].error == "too small"


def test_pictures_become_text_only_where_nothing_changed(spark):
    t, good = "see ![](img:a.png) and ![](img:a.png)", [0.1, 0.1, 0.5, 0.5]
    rows = [("ok", "a.png", good, t), ("gone", "b.png", good, t), ("area", "a.png", [0.1, 0.1, 0.1, 0.5], t), ("empty", "a.png", good, t), ("figure", "a.png", good, t), ("maths", "a.png", good, t), ("moved", "a.png", good, t + "!"), ("path", "x/a.png", good, t), ("nul", None, None, None)]
    r = spark.createDataFrame([(i, 1, "k", "question", n, a, s) for i, n, a, s in rows], "req_id string, doc_id int, key string, part string, name string, area array<double>, seen string")
    ans = spark.createDataFrame([(i, "" if i == "empty" else "[[FIGURE]]" if i == "figure" else "$y$", "", ["bad"] if i == "maths" else []) for i, *_ in rows], "req_id string, question string, solution string, faults array<string>")
    got = {x.req_id: (x.text, x.error) for x in selections.picture_read(r, spark.createDataFrame([(1, "k", "question", t)], "doc_id int, key string, part string, text string"), ans).collect()}
    assert got["ok"] == (r"see \(y\) and ![](img:a.png)", None)
    assert [got[k][1] for k in ("gone", "area", "empty", "figure", "maths", "moved", "path", "nul")] == ["the picture is no longer in the text", "not an area", "no text was read", "no text was read", "invalid maths", "the text changed meanwhile", "not a picture", "not a picture"]


def test_a_model_is_asked_twice_at_most(spark):
    said = []

    def ask(p, faults):
        return {"cut": {"text": "x", "cut": True}, "good": {"text": "ok"}, "mend": {"text": "{}" if faults else "{"}, "worse": {"text": "{{" if faults else "{"}, "odd": {"text": "\x07"}, "mended": {"text": "ok" if faults is not None else "\x07"}, "null": {}}[p]

    rows = spark.createDataFrame([(k, k) for k in ("cut", "good", "mend", "worse", "odd", "mended", "null", "boom")], "id string, payload string")
    got = {r.id: (r.text, len(r.faults), r.error, r.calls) for r in selections.transcribed(rows, ask, lambda t: ["brace"] * (t.count("{") - t.count("}"))).collect()}
    assert got == {"cut": (None, 0, "cut off", 1), "good": ("ok", 0, None, 1), "mend": ("{}", 0, None, 2), "worse": ("{", 1, None, 2), "odd": (None, 0, "control characters", 2), "mended": ("ok", 0, None, 2), "null": ("", 0, None, 1), "boom": (None, 0, "'boom'", 1)} and said == []
    a = spark.createDataFrame([("m", "x", "x"), ("m", None, "x"), ("m", "y", None), ("n", "y", "x")], "by string, said string, truth string")
    assert {tuple(r) for r in selections.accuracy(a, ["by"]).collect()} == {("m", 2, 1, 1, 0.5), ("n", 1, 1, 0, 0.0)}


def test_nested_strings_and_maps(spark):
    d = spark.sql(r"select 1 as id, named_struct('a', '\\(x\\)', 'b', array(named_struct('c', '\\[y\\]', 'n', 3), null), 'm', map('k', '\\(z\\)'), 'e', cast(null as string)) as v union all select 2, null")
    kind = d.schema["v"].dataType
    r = {x.id: x for x in d.select("id", X.converted(F.col("v"), kind, X.to_dollar_delims).alias("v"), X.changes(F.col("v"), kind, X.to_dollar_delims).alias("n")).collect()}
    assert r[1].v.a == "$x$" and r[1].v.b[0].c == "$$y$$" and r[1].v.b[0].n == 3 and r[1].v.b[1] is None and r[1].v.m == {"k": "$z$"} and r[1].n == 3 and r[2].v is None and r[2].n == 0
    m = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3') as y union all select null, map('c', '4')").select(X.merged_maps("x", "y").alias("m"))
    assert sorted(map(str, (r.m for r in m.collect()))) == ["{'a': '1', 'b': '3'}", "{'c': '4'}"]


def test_updates_totals_and_gates(spark):
    rows = spark.createDataFrame([("a", "old", "s", "t0"), ("b", "old", "s", "t0")], "k string, label string, status string, updatedAt string")
    ch = spark.createDataFrame([("a", " new ", None), ("b", " ", "x"), ("z", "q", "x")], "k string, label string, status string")
    new, refused = sets.updated(rows, ch, "k", "label", F.lit("t1"))
    assert {tuple(r) for r in new.collect()} == {("a", "new", "s", "t1"), ("b", "old", "s", "t0")} and {tuple(r) for r in refused.collect()} == {("z", "missing"), ("b", "blank label")}
    t = R.run_totals(spark.createDataFrame([("r", "done", None), ("r", "failed", "w"), ("r", None, "")], "run string, outcome string, warning string"), "run").first()
    assert (t.total, t.done, t.failed, t.warnings, t.missing) == (3, 1, 1, 1, 0)
    s = spark.createDataFrame([("f", i, k, x) for i, (k, x) in enumerate([("inline", "f"), ("sup", "-"), ("sup", "1"), ("inline", r"\in"), ("inline", "R"), ("sub", "2")])] + [("g", 0, "inline", r"\in"), ("g", 1, "sup", "a")], "id string, pos int, kind string, tex string")
    assert {r.id: r.formula for r in R.script_runs(s, "id", "pos").collect()} == {"f": r"f^{-1}\in R_{2}", "g": r"\in^{a}"}
    assert clusters.join_scripts([("inline", r"\in"), ("sup", "a")]) == r"\in^{a}"


def test_timed_tables(spark):
    now, reads = [0.0], []

    def read(name):
        reads.append(name)
        return spark.createDataFrame([(1,)], "n int")

    t = sets.TimedTables(read, 5, lambda: now[0])
    t.get("a")[0]["n"] = 9
    now[0] = 4.9
    assert t.get("a") == [{"n": 1}] and reads == ["a"]
    now[0] = 5.0
    assert t.get("a") == [{"n": 1}] and reads == ["a", "a"]
    t.forget("a")
    assert t.get("a") and len(reads) == 3 and t.get("b") and len(reads) == 4


def test_page_readers(spark):
    w = spark.createDataFrame([(1, 1, "hi", 1.0, 2.0, 3.0, 4.0), (1, 1, "", 1.0, 2.0, 3.0, 4.0), (1, 1, None, 1.0, 2.0, 3.0, 4.0)], "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double")
    b = spark.createDataFrame([(1, 1, "a", [0.0, 0.0, 9.0, 9.0]), (1, 1, "thin", [0.0, 0.0, 3.0, 9.0]), (1, 1, "alias", [0.0, 0.0, 9.0, 9.0]), (1, 1, "nul", None)], "doc_id int, page int, name string, bbox array<double>")
    a = spark.createDataFrame([(1, 1, "alias", "a")], "doc_id int, page int, name string, alias_of string")
    assert sorted(r.value for r in lines.page_tokens(w, b, a).collect()) == ["a", "hi"]
    read = spark.createDataFrame([(1, 2, 0, "p"), (1, 2, 1, "q"), (1, 1, 0, "no")], "doc_id int, page int, pos int, text string")
    every = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id int, page int")
    assert {(r.page, r.text, r.fallback) for r in lines.with_fallback(w.limit(1), every, read).collect()} == {(1, "hi", False), (2, "p", True), (2, "q", True)}
    t = spark.createDataFrame([(1, 0, "1.1 Light  and Glass."), (1, 1, "1.2 SUMMARY"), (1, 2, "1.2.1 Deeper Matters"), (1, 3, "1.3 light and glass"), (2, 0, "2.1.1 Only Subsections"), (3, 0, None), (4, 0, " 4.1 Light  and Glass "), (4, 1, "4.2 LIGHT AND GLASS"), (4, 2, "4.3 Heat")], "doc_id int, line_no int, text string")
    assert {(r.doc_id, r.pos, r.number, r.name) for r in syllabus.chapter_topics(t.where("doc_id < 9")).collect()} == {(2, 0, "2.1.1", "Only Subsections"), (4, 0, "4.1", "Light and Glass"), (4, 1, "4.3", "Heat")}
    o = spark.createDataFrame([("in", [10.0, 100.0, 50.0, 120.0]), ("head", [10.0, 20.0, 50.0, 80.0]), ("foot", [10.0, 700.0, 50.0, 740.0]), ("rule", [10.0, 100.0, 500.0, 101.0]), ("nul", None), ("odd", [1.0, None, 2.0, 3.0])], "name string, bbox array<double>")
    assert [r.name for r in clusters.drawing_boxes(o).collect()] == ["in"]
    assert [r.v for r in spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b""),), (None,)], "c binary").select(D.is_pdf("c").alias("v")).collect()] == [True, False, False]
    assert {tuple(r) for r in D.settings_rows(spark.createDataFrame([(1, "export A = 'x y'"), (2, "# no"), (3, "B="), (4, None)], "n int, line string"), "line", "n").collect()} == {(1, "A", "x y"), (3, "B", "")}


def test_labels_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)] + [(99, None)], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(i % 7, rng.normal(size=6).tolist()) for i in range(20)], "label int, embedding array<double>")
    rows = lambda: {(r.vec_id, r.label, round(r.score, 9)) for r in clusters.nearest_labels(v, c).collect()}
    whole = rows()
    monkeypatch.setattr(clusters, "TEMPLATES", 3)
    assert rows() == whole and len(whole) == 30 and clusters.nearest_labels(v, c.limit(0)).count() == 0


def test_figures_are_placed_by_batches(spark):
    d = spark.createDataFrame([(1, "x [[FIGURE]] y\n\n z", "", []), (2, "First line\nSecond", "First line\n![](img:a.png)\nmore", ["a.png"]), (3, None, None, None), (4, None, None, ["b.png"])], "id int, ai string, original string, figures array<string>")
    assert {r.id: r.placed for r in review.place_figures(d, "ai", "original", "figures").collect()} == {1: "x y\n z", 2: "First line\n![](img:a.png)\nSecond", 3: "", 4: "![](img:b.png)"}
    assert lines.fold_page(pd.DataFrame(columns=["kind", "value", "x0", "x1", "top", "bottom"])).empty


def test_questions_are_read_anew_with_their_figures(spark):
    rows = [(1, "a", "question", "q [[eq:f.png]] [[eq:m.png]]", ["f.png", "m.png"], None), (1, "a", "solution", "s old [[eq:g.png]]\n[[eq:f.png]] tail", ["g.png", "f.png"], None), (1, "b", "question", "q [[eq:f.png]]", ["f.png"], "edited without it"), (1, "b", "solution", None, None, None), (1, "c", "question", "x", [], None)]
    p = spark.createDataFrame(rows, "doc_id int, key string, part string, text string, equations array<string>, override string")
    r = spark.createDataFrame([(1, "a", "question", "f.png", None, "figure", False), (1, "a", "question", "m.png", "x", "model", False), (1, "a", "solution", "g.png", None, "figure", False), (1, "b", "question", "f.png", None, "figure", False)], READ)
    a = spark.createDataFrame([(1, "a", "q new $x$", "s new", ["bad"]), (1, "b", "other", None, None)], "doc_id int, key string, question string, solution string, faults array<string>")
    got = {(x.key, x.part): (x.text, x.warned) for x in selections.reread(p, r, a).collect()}
    assert got == {("a", "question"): ("q new \\(x\\)\n![](img:f.png)", True), ("a", "solution"): ("s new\n![](img:g.png)", True), ("b", "question"): ("other", False), ("b", "solution"): ("", False)}
    pr = spark.createDataFrame([("p", "P", 2), ("o", "O", 3)], "projectId string, label string, updatedAt int")
    se = spark.createDataFrame([("s", None, "p", None, None, 1), ("t", "T", None, "done", "d", 9)], "sessionId string, label string, projectId string, status string, driveFileId string, updatedAt int")
    assert [(x.kind, x.id, x.label, x.status) for x in sets.project_rows(pr, se).collect()] == [("project", "o", "O", None), ("project", "p", "P", None), ("session", "t", "T", "done"), ("session", "s", "Untitled OCR session", "open")]
