from pyspark.sql import functions as F

from quillmark.operators import lines, review, structure

SCHEMA = "doc_id int, line_no int, page int, text string, x0 double, x1 double, top double, bottom double"


def make(spark, texts, doc=1, start=0, page=1):
    return spark.createDataFrame([(doc, start + i, page, t, 50.0, 90.0, 60.0 + 15 * i, 71.5 + 15 * i) for i, t in enumerate(texts)], SCHEMA)


GOLDEN = [
    "front matter", "Question 4: What is two?", "Answer 4: Two.", "ADDITIONAL EXERCISES", "stray", "Question A1: First?", "Solution:", "One.", "Question A2: Second?",
    "Answer the following", "Sol. Done.", "Solution: again", "EXERCISE 1", "[[eq:p001_eq000.png]] Question 1: Draw.", "Ans.",
]


def test_splitter_titles_labels_and_sections(spark):
    got = {(r.title, r.label): r for r in structure.sections(make(spark, GOLDEN)).collect()}
    assert set(got) == {("UNKNOWN", "4"), ("ADDITIONAL EXERCISES", "A1"), ("ADDITIONAL EXERCISES", "A2"), ("EXERCISE 1", "1")}
    assert got["UNKNOWN", "4"].solution_text == "Two." and got["UNKNOWN", "4"].heading == "answer"
    assert got["ADDITIONAL EXERCISES", "A1"].solution_text == "One."
    two = got["ADDITIONAL EXERCISES", "A2"]
    assert two.question_text == "Second?\nAnswer the following" and two.solution_text == "Done.\nSolution: again" and two.number == 2
    one = got["EXERCISE 1", "1"]
    assert one.question_text == "[[eq:p001_eq000.png]] Draw." and one.solution_text == "" and one.heading == "answer"


def test_long_documents_are_cut_into_blocks(spark, monkeypatch):
    t = make(spark, ["Chapter 1", *GOLDEN, *GOLDEN[3:], "Chapter 2 again"]).unionByName(make(spark, GOLDEN, doc=2, start=5))
    whole = sorted(map(str, structure.sections(t).collect()))
    for n in (1, 2, 5):
        monkeypatch.setattr(structure, "BLOCK", n)
        assert sorted(map(str, structure.sections(t).collect())) == whole


def test_chapter_line_is_taken_once(spark):
    got = structure.sections(make(spark, ["Chapter 3 Light", "Q.1 See", "Chapter 4 is next"])).collect()
    assert [r.question_text for r in got] == ["See\nChapter 4 is next"]


def test_nulls_repeats_and_empty(spark):
    base = make(spark, ["Q.1 a", None, "b"])
    twice = base.unionByName(base).withColumn("x1", F.lit(None).cast("double")).withColumn("extra", F.lit(1))
    got = structure.sections(twice).collect()
    assert len(got) == 1 and got[0].question_text == "a\nb" and got[0].lines == 2
    assert structure.regions(twice).count() == 0
    assert structure.sections(make(spark, [])).count() == 0


def test_regions_and_page_numbers(spark):
    t = spark.createDataFrame([(1, 0, 1, "Q.1 a", 50.0, 90.04, 100.0, 110.0), (1, 1, 1, "b", 40.0, 95.0, 115.0, 126.0), (1, 2, 1, "- 7 -", 290.0, 300.0, 770.0, 780.0), (1, 3, 2, "c", 51.0, 80.0, 60.0, 70.0)], SCHEMA)
    t = structure.without_page_numbers(t)
    assert t.count() == 3
    got = sorted((r.page, r.x0, r.top, r.x1, r.bottom) for r in structure.regions(t).collect())
    assert got == [(1, 40.0, 100.0, 95.0, 126.0), (2, 51.0, 60.0, 80.0, 70.0)]


def test_slot_and_markdown(spark):
    t = make(spark, ["EXERCISE 1", "Q.1 a", "EXERCISE 2", "Q.1 b", "Q.7 c"])
    s = structure.sections(t)
    assert [(r.page, r.exercise, r.next_number) for r in structure.slot_for(s, t).collect()] == [(1, 1, 8)]
    md = structure.markdown(s).first().markdown
    assert md.index("## EXERCISE 1") < md.index("### Question 1") < md.index("## EXERCISE 2") < md.index("### Question 7")


def test_fold_lines_order_and_pictures(spark):
    tok = spark.createDataFrame(
        [(1, 1, "text", "world", 60.0, 100.0, 100.5, 110.0), (1, 1, "text", "hello", 10.0, 50.0, 100.0, 110.0), (1, 1, "eq", "p001_eq000.png", 110.0, 120.0, 99.0, 112.0),
         (1, 1, "eq", "p001_eq001.png", 10.0, 90.0, 95.0, 200.0), (1, 1, "text", "12", 290.0, 300.0, 770.0, 780.0), (1, 1, "text", "lost", None, None, None, None)],
        "doc_id int, page int, kind string, value string, x0 double, x1 double, top double, bottom double",
    )
    got = [r.text for r in lines.fold_lines(tok).orderBy("line_no").collect()]
    assert got == ["[[eq:p001_eq001.png]]", "hello world [[eq:p001_eq000.png]]"]


def test_synthetic_positions_and_ocr(spark):
    t = spark.createDataFrame([(1, 1, i, f"l{i}") for i in range(2)], "doc_id int, page int, pos int, text string")
    got = [(r.top, r.bottom) for r in lines.synthetic_positions(t).orderBy("pos").collect()]
    assert got == [(47.5, 396.0), (396.0, 744.5)]
    o = spark.createDataFrame([("plain words", 0.9, 500.0), ("x=3+4", 0.9, 500.0), ("Sol. 0.36", 0.7, 500.0), ("Page | 1", 0.9, 50.0), ("hm", 0.2, 500.0)], "text string, confidence double, bottom double")
    assert [(r.becomes, r.kept) for r in lines.trusted_ocr(o).collect()] == [("text", "plain words"), ("ink", None), ("heading", "Sol."), ("header", None), ("ink", None)]


def test_remap_cascade(spark):
    cols = "doc_id int, exercise bigint, question bigint, title string, label string, page_start int, question_text string"
    old = spark.createDataFrame([(1, 0, 0, "UNKNOWN", "1", 1, "What is it?"), (1, 0, 1, "UNKNOWN", "1", 2, "Other")], cols)
    new = spark.createDataFrame([(1, 0, 0, "UNKNOWN", "1", 1, "What  is it?"), (1, 1, 0, "A", "9", 2, "z"), (1, 2, 0, "EXERCISE 1", "1", 2, "Other text")], cols)
    got = {(r.old_key, r.new_key) for r in review.remap(old, new).collect()}
    assert got == {("0-0", "0-0"), ("0-1", "2-0")}


def test_carried_edits(spark):
    e = spark.createDataFrame([(1, "0-0", "a"), (1, "0-1", "b"), (1, "add-7", "c")], "doc_id int, key string, edit string")
    m = spark.createDataFrame([(1, "0-0", "1-0")], "doc_id int, old_key string, new_key string")
    lab = spark.createDataFrame([(1, "0-1", "UNKNOWN|5")], "doc_id int, key string, label string")
    kept, lost = review.carried(e, m, lab)
    assert {(r.key, r.edit) for r in kept.collect()} == {("1-0", "a"), ("add-7", "c")}
    assert [(r.orphan, r.edit) for r in lost.collect()] == [("UNKNOWN|5|0-1", "b")]


def test_audit_adds_once(spark):
    f = spark.createDataFrame([(1, 2, 5, 0), (1, 2, 5, 1), (1, 2, 6, 2)], "doc_id int, page int, number int, pos int")
    known = spark.createDataFrame([(1, 2, "6")], "doc_id int, page int, label string")
    got = review.audited(f, known)
    assert [(r.number, r.pos) for r in got.collect()] == [(5, 0)]
    again = known.unionByName(got.select("doc_id", "page", "label"))
    assert review.audited(f, again).count() == 0
