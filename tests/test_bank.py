import datetime as dt

from pyspark.sql import functions as F

from quillmark.operators import export, review, sets, structure, syllabus
from quillmark.operators import rollups as R

LINES = "doc_id int, line_no int, page int, text string, x0 double, x1 double, top double, bottom double"
NOW = "2024-01-01T00:00:00.000Z"


def test_pick_keeps_false_and_zero(spark):
    d = spark.sql("select '' as m, cast(null as string) as d, 'auto' as a, false as b, 0 as z")
    r = d.select(review.pick("m", "d", "a").alias("x"), review.pick(F.col("b"), F.lit(True)).alias("y"), review.pick("z", F.lit(5)).alias("z")).first()
    assert (r.x, r.y, r.z) == ("auto", False, 0)


def test_latest_with_hot_key_and_ties(spark):
    rows = [("hot", i % 7, f"v{i}") for i in range(2000)] + [("b", 1, "x"), ("b", 1, "x")]
    got = {r.k: r.v for r in review.latest(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], ["t", "v"]).collect()}
    assert got == {"hot": max(v for _, t, v in rows[:2000] if t == 6), "b": "x"}


def test_guess_refuses_ties_and_uses_hints(spark):
    s = spark.createDataFrame([("Class 9", "Maths", "Statistics", "a", 0, "o"), ("Class 10", "Maths", "Statistics", "b", 0, "o"), ("Class 9", "Physics", "Motion in a Line", "c", 0, "o")], "className string, subject string, chapter string, topic string, pos int, source string")
    t = spark.createDataFrame([(1, "Statistics", "Maths", None), (2, "Statistics", "Maths", "Class 10"), (3, "The Motion in Line", None, None), (4, "Nothing alike", None, None), (5, None, None, None), (6, "Motion in a line", "Maths", None)], "id int, title string, subject string, class_hint string")
    got = {r.id: r.key for r in syllabus.guess(t, s).collect()}
    assert got == {1: None, 2: "Class 10/Maths/Statistics", 3: "Class 9/Physics/Motion in a Line", 4: None, 5: None, 6: "Class 9/Physics/Motion in a Line"}
    assert syllabus.guess(t.limit(0), s).count() == 0


def test_syllabus_file_and_fuzzy(spark):
    raw = spark.createDataFrame([('{"Class 9/Maths/Circles": {"topics": ["a", "b"], "source": "s"}, "odd": {"topics": ["c"]}}',), ("{broken",), (None,)], "value string")
    assert [(r.chapter, r.pos, r.topic) for r in syllabus.from_json_map(raw).collect()] == [("Circles", 0, "a"), ("Circles", 1, "b")]
    t = spark.createDataFrame([(1, "olynomials"), (2, "quite other")], "id int, title string")
    c = spark.createDataFrame([("Polynomials", 1), ("Circles", 2)], "candidate string, ord int")
    assert [(r.id, r.candidate) for r in syllabus.fuzzy_match(t, c).collect()] == [(1, "Polynomials")]


def test_topics_and_tags(spark):
    s = spark.createDataFrame([("C", "S", "X", "t1", 0, "o")], "className string, subject string, chapter string, topic string, pos int, source string")
    r = spark.createDataFrame([(1, ["own"], None, None), (2, [], "C/S/X", None), (3, None, None, "C/S/X"), (4, None, "none", "C/S/X"), (5, None, None, None)], "id int, own array<string>, chosen string, guessed string")
    allowed = syllabus.topics_allowed(r, s)
    assert {x.id: x.topics for x in allowed.collect()} == {1: ["own"], 2: ["t1"], 3: ["t1"], 4: [], 5: []}
    a = spark.createDataFrame([(2, "k", "t1", "HARD"), (3, "k", "T1", "easy"), (4, "k", None, None)], "id int, key string, topic string, level string")
    assert {x.id: (x.topic, x.level, x.placed) for x in syllabus.accepted_tags(a, allowed).collect()} == {2: ("t1", "hard", True), 3: (None, "easy", False), 4: (None, None, False)}


def test_duplicates_of_files(spark):
    known = spark.createDataFrame([("f1", "A.pdf", "h1", 1), ("f2", "B.pdf", None, 2), ("f3", "a.PDF", "h1", 3)], "file_id string, fileName string, sha string, pos int")
    up = spark.createDataFrame([("u1", "x.pdf", "h1"), ("u2", "b.PDF", "h9"), ("u3", "A.pdf", "h2"), ("u4", None, None)], "upload_id string, fileName string, sha string")
    got = {r.upload_id: (r.file_id, r.match) for r in sets.duplicates_of_files(up, known).collect()}
    assert got == {"u1": ("f1", "content"), "u2": ("f2", "filename"), "u3": (None, None), "u4": (None, None)}


def test_cache_errors_are_not_hits(spark):
    w = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m3")], "id string, md5 string")
    c = spark.createDataFrame([("v2:m:m1", "formula", "x", None), ("v2:m:m2", "formula", None, "timeout"), ("v2:m:m3", "figure", None, None), ("v1:m:m2", "formula", "y", None)], "key string, kind string, latex string, error string")
    hits, miss = sets.cache_lookup(w, c, "2", "m")
    assert {r.id for r in hits.collect()} == {"a", "c"} and [r.md5 for r in miss.collect()] == ["m2"]


def test_set_operators(spark):
    d = spark.createDataFrame([("64b1cda2d00069ce2d0991b4", "s1"), ("bad", "s1"), ("64b1cda2d00069ce2d0991b5", "s2"), ("64b1cda2d00069ce2d0991b6", None)], "documentId string, sessionId string")
    s = spark.createDataFrame([("s1", None), ("s2", dt.datetime(2024, 1, 1))], "sessionId string, deletedAt timestamp")
    assert [(r.documentId, r.sessionId) for r in sets.active_links(d, s).collect()] == [("64b1cda2d00069ce2d0991b4", "s1")]
    a, b = (spark.createDataFrame(x, "k string") for x in ([("1",), ("2",), (None,)], [("2",), ("3",), ("3",)]))
    assert {(r.k, r.state) for r in sets.missing_and_stale(a, b, "k").collect()} == {("1", "missing"), ("3", "stale")}
    r1 = spark.createDataFrame([("j", 1)], "job string, v int")
    r2 = spark.createDataFrame([("j", 2), ("k", 3)], "job string, v int")
    assert {(r.job, r.v) for r in sets.first_root_wins([r1, r2], "job").collect()} == {("j", 1), ("k", 3)}
    docs = spark.createDataFrame([(1, [3]), (2, None)], "doc_id int, scanned_pages array<int>")
    names = spark.createDataFrame([(1, "p002_ocr000.png"), (1, "p003_ocr000.png"), (2, "p001_eq000.png")], "doc_id int, name string")
    assert {r.doc_id: r.pages for r in sets.pages_seen(docs, names).collect()} == {1: [2, 3], 2: []}
    f = spark.sql("select 'local:1' as a, '' as b, cast(null as string) as c, 'real' as d").select(sets.drive_id("a", "b", "c", "d").alias("o"))
    assert f.first().o == "real"
    p = spark.createDataFrame([("x", '<a href="/v/b/one/7"><a href="/v/b/two/7"><a href="/v/b/three/8">')], "page_id string, html string")
    assert [(r.slug, r.id) for r in sets.links_in(p, r'href="(/v/[^"]*/\d+)"').orderBy("pos").collect()] == [("one", "7"), ("three", "8")]


def test_guarded_write_retention_and_faults(spark):
    cur = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", None)], "key string, text string")
    new = spark.createDataFrame([("a", "old", "new"), ("b", "was", "new"), ("c", None, "new")], "key string, expected string, new_text string")
    assert {r.key: (r.text, r.written) for r in review.write_if_unchanged(cur, new).collect()} == {"a": ("new", True), "b": ("old", False), "c": ("new", True)}
    ten = "one two three four five six seven eight nine ten"
    p = spark.createDataFrame([(1, ten, "one two three"), (2, ten, ten), (3, "few words", "none"), (4, None, None)], "id int, original string, rewritten string")
    assert {r.id: (r.kept, r.accepted) for r in review.retention(p).collect()} == {1: (3, False), 2: (10, True), 3: (0, True), 4: (0, True)}
    q = spark.createDataFrame([("![](a)", "text"), ("x", "x\x1f"), ("x", r"\(x"), ("x", "x_2"), ("x", ""), ("x ![](a)", "y ![](a)")], "original string, rewritten string")
    assert [r.f for r in q.select(review.repair_fault().alias("f")).collect()] == ["image reference changed", "control characters", "unmatched delimiters", "script outside maths", "no text", None]


def test_place_figures():
    o = "First line of text\n![](img:a.png)\nSecond line here\n![](img:b.png)"
    assert review.place_figures_text("First line of text\nSecond line here", o, ["a.png", "b.png"]) == "First line of text\n![](img:a.png)\nSecond line here\n![](img:b.png)"
    assert review.place_figures_text("x [[FIGURE]] y", "", []) == "x y"
    assert review.place_figures_text("a\n[[FIGURE]] b", "", ["new.png"]) == "a\n![](img:new.png)\nb"
    assert review.place_figures_text("text", "![](img:a.png)\nlater", ["a.png"]) == "![](img:a.png)\ntext"


def records(spark, manual=(), **doc):
    t = ["EXERCISE 1.1", "Question 1: What is 1 + 1? (a) one (b) two", "Answer: Correct option is (b) [[eq:p001_eq000.png]]", "Question 2: See [[eq:p001_eq001.png]] now", "Solution: Work."]
    lines = spark.createDataFrame([(1, i, 1, x, 50.0, 90.0, 60.0 + 15 * i, 71.0 + 15 * i) for i, x in enumerate(t)], LINES)
    q = structure.sections(lines)
    m = spark.createDataFrame(list(manual), export.MANUAL)
    names = spark.createDataFrame([], export.DOCUMENT).schema.names
    d = spark.createDataFrame([tuple({"doc_id": 1, **doc}.get(n) for n in names)], export.DOCUMENT)
    boxes = spark.createDataFrame([(1, 1, "p001_eq000.png", [61.2, 79.2, 122.4, 158.4]), (1, 1, "p001_eq001.png", None)], "doc_id int, page int, name string, bbox array<double>")
    return export.records(q, m, d, structure.regions(lines), boxes, NOW)


def test_export_record_schema_and_routing(spark):
    r = records(spark, documentId="64b1cda2d00069ce2d0991b4", questionType="single_correct", exam=" boards ")
    assert r.schema.simpleString() == spark.createDataFrame([], export.RECORD).schema.simpleString() and len(r.columns) == 34
    one, two = r.orderBy("questionNumber").collect()
    assert (one.answer, one.explanation, one.stem) == ("B", "Correct option is (b)", "What is 1 + 1?") and [o.isCorrect for o in one.options] == [False, True]
    assert one.explanationImages == ["images/p001_eq000.png"] and one.answerImages == [] and one.imageCrops[0].type == "solution"
    assert one.imageCrops[0].nw == 170.0 and one.path.section == "All sections" and one.exam == "BOARDS" and one.sectionName == "EXERCISE 1.1"
    assert (two.answer, two.explanation, two.isQuestionImage, two.questionImage) == ("", "Work.", True, "images/p001_eq001.png") and two.stem == "See now"
    assert sorted(x.id for x in records(spark).select("id").collect()) == sorted((one.id, two.id))


def test_export_overrides(spark):
    names = spark.createDataFrame([], export.MANUAL).schema.names
    row = lambda **k: tuple({"doc_id": 1, **k}.get(n) for n in names)
    r = records(spark, [row(key="0-0", skip=True), row(key="0-1", stemOverride="", solutionOverride="New ![](img:manual_000.png)", isPyq=True, pyqYear="2019", flagged=False)], answerFrom="answer").collect()
    assert len(r) == 1
    assert (r[0].stem, r[0].answer, r[0].explanation, r[0].answerImages, r[0].pyqYear, r[0].isPyq, r[0].flagged) == ("", "New", None, ["images/manual_000.png"], 2019, True, False)


def test_stored_form_names_and_urls(spark):
    r = records(spark, documentId="64b1cda2d00069ce2d0991b4")
    old = r.withColumn("imageCrops", F.transform("imageCrops", lambda c: c.withField("type", F.lit("explanation")))).withColumn("explanationImages", F.lit(None).cast("array<string>"))
    d = export.to_documents(old).orderBy("questionNumber").first()
    assert d.imageCrops[0].type == "solution" and d.explanationImages == ["images/p001_eq000.png"] and d.createdAt == dt.datetime(2024, 1, 1)
    n = export.object_names(r)
    assert n.collect() == export.object_names(r).collect()
    x = n.first()
    assert x.object == f"{x.id}_question_0_{int(x.id[:8], 16) * 1000}" and x.file == "p001_eq000.png"
    w = export.rewritten_urls(r.withColumn("explanation", F.lit("see ![](images/p001_eq000.png)")), n.select("id", "url", F.lit("https://s/o").alias("new_url"))).orderBy("questionNumber").first()
    assert w.imageCrops[0].url == "https://s/o" and w.explanation == "see ![](https://s/o)" and w.images == ["https://s/o"]


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1, "t0"), ("b", 1, "t0")], "id string, v int, createdAt string")
    up = spark.createDataFrame([("a", 2, "t1"), ("a", 3, "t2"), ("c", 9, "t1")], "id string, v int, createdAt string")
    got = {r.id: (r.v, r.createdAt, r.action) for r in export.upserted(base, up, "id", ["v"], on_insert=("createdAt",)).collect()}
    assert got == {"a": (3, "t0", "updated"), "b": (1, "t0", "kept"), "c": (9, "t1", "new")}


def test_rollups(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)]
    got = sorted((r.g, r.run, r.v, r.n) for r in R.islands(spark.createDataFrame(rows, "g int, t int, v string"), "g", ["t"], "v", F.floor(F.col("t") / 2)).collect())
    assert got == [(1, 1, "a", 2), (1, 2, None, 2), (1, 3, "a", 1), (2, 1, None, 1)]
    m = spark.createDataFrame([("q", "x (a) one (b) two", 2, 6), ("q", "x (a) one (b) two", 10, 14)], "id string, text string, start int, end int")
    assert [r.body for r in R.option_bodies(m).orderBy("start").collect()] == ["one", "two"]
    k = R.keep_first(spark.createDataFrame([(2, "A"), (1, "a"), (3, "b")], "i int, s string"), [F.lower("s")], ["i"])
    assert sorted((r.i, r.s) for r in k.collect()) == [(1, "a"), (3, "b")]
    s1 = spark.createDataFrame([("g", 1, "x"), ("g", 2, None)], "g string, i int, t string")
    s2 = spark.createDataFrame([("g", 2, None), ("g", 1, "x")], "g string, i int, t string")
    assert R.signature(s1, "g", ["i", "t"]).collect() == R.signature(s2, "g", ["i", "t"]).collect()
    assert R.signature(s1, "g", ["i", "t"]).first().signature != R.signature(s1.limit(1), "g", ["i", "t"]).first().signature


def test_islands_and_batches_over_cuts_against_brute_force(spark):
    import random
    from itertools import groupby

    rng = random.Random(1)
    rows = [(g, t, rng.choice(["a", "b", None])) for g in range(3) for t in range(60)]
    d = spark.createDataFrame(rows, "g int, t int, v string")
    want = set()
    for g in range(3):
        for run, (v, own) in enumerate(groupby([r for r in rows if r[0] == g], key=lambda r: r[2]), 1):
            ts = [r[1] for r in own]
            want.add((g, run, v, len(ts), ts[0], ts[-1]))
    for width in (1, 7, 1000):
        cut = F.floor(F.col("t") / width)
        assert {(r.g, r.run, r.v, r.n, r.first_at, r.last_at) for r in R.islands(d, "g", ["t"], "v", cut).collect()} == want
        assert {(r.g, r.t, r.batch) for r in R.numbered_batches(d, "g", ["t"], 12, cut).collect()} == {(g, t, t // 12) for g, t, _ in rows}


def test_gate_and_missing(spark):
    d = spark.sql("select named_struct('module', 'm', 'chapter', '') as path, 's' as subject, cast(null as string) as topic, 'easy' as level, 'x' as questionType, false as flagged")
    assert d.select(review.missing_fields().alias("m")).first().m == ["topic", "chapter"]
    assert R.gate(d).first().passes is False and R.gate(d.limit(0)).first().passes is False
