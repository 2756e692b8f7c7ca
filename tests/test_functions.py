from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import text as X


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def col(spark, values, f):
    return [r.o for r in spark.createDataFrame([(v,) for v in values], "t string").select(f("t").alias("o")).collect()]


def test_delimiters(spark):
    got = col(spark, ["a $x$ b", "$$y$$ and $z$", r"cost \$5", None, "one $ only", ""], X.to_paren_delims)
    assert got == [r"a \(x\) b", r"\[y\] and \(z\)", r"cost \$5", None, "one $ only", ""]
    assert col(spark, [r"a \(x\) \[y\]", None], X.to_dollar_delims) == ["a $x$ $$y$$", None]
    assert col(spark, [r"a \(x\) $y$ \[z\]", ""], X.maths_spans) == [["x", "y", "z"], []]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab xé\n", min_size=1, max_size=12), min_size=1, max_size=5))
def test_delimiter_round_trip(spark, parts):
    t = "".join(p + rf"\({i}+k\)" for i, p in enumerate(parts))
    assert one(spark, t, X.to_paren_delims(X.to_dollar_delims("t")).alias("o")).o == t


def test_images_in_text(spark):
    assert col(spark, ["x ![](a/b.png)  y\n\n\n\nz ", None, ""], X.strip_images) == ["x y\n\nz", None, ""]
    r = one(spark, "a ![](img:m.png) b ![](img:n.png)", X.resolve_refs("t", "images/")[0].alias("a"), X.resolve_refs("t", "images/")[1].alias("b"))
    assert r.a == "a ![](images/m.png) b ![](images/n.png)" and r.b == ["m.png", "n.png"]
    d = spark.sql(r"select 'v [[eq:a]] [[eq:b]] [[eq:c]]' as t, map('a', struct('x^2' as latex, false as needs_review), 'b', struct('y' as latex, true as needs_review), 'c', struct('' as latex, false as needs_review)) as m")
    assert d.select(X.fill_readings("t", "m").alias("o")).first().o == r"v \(x^2\) [[eq:b]] "


def test_options(spark):
    rows = [("Pick (a) one (b) two", "single_correct"), ("Pick (a) one (b) two", "subjective"), ("Pick (b) one (c) two", "single_correct"), ("Pick (a) one (a) two", "single_correct"), ("A. x\nC) y\nB. z", "true_false"), (None, "single_correct"), ("plain", "single_correct"), ("(a) ", "single_correct")]
    d = spark.createDataFrame(rows, "t string, q string")
    stem, opt = X.split_options("t", "q")
    got = [(r.s, [(o.label, o.body) for o in r.o]) for r in d.select(stem.alias("s"), opt.alias("o")).collect()]
    assert got[0] == ("Pick", [("A", "one"), ("B", "two")])
    assert got[1] == ("Pick (a) one (b) two", []) and got[2][1] == [] and got[3][1] == []
    assert got[4] == ("", [("A", "x"), ("C", "y"), ("B", "z")])
    assert got[5] == (None, []) and got[6] == ("plain", []) and got[7][1] == []
    m = d.limit(1).select(opt.alias("o"), F.lit("nothing").alias("a"), F.lit("Correct option is (b)").alias("b")).select(X.mark_correct("o", "a", "b").alias("o")).first().o
    assert [x.isCorrect for x in m] == [False, True]
    assert col(spark, ["Ans. (c)", "Answer: C", "(b) is correct", "correct option is (d)", "answers vary", None], X.named_option) == ["C", "C", "B", "D", None, None]


def test_exams_years_numbers(spark):
    assert col(spark, ["Board", "board", "Boards", " boards ", "BOARDS", " CBSE ", "", None], X.normalize_exam) == ["BOARDS"] * 5 + ["CBSE", None, None]
    assert col(spark, ["[JEE Main 2019]", "(neet, 2021)", "in 2019", None], X.pyq_exam) == ["JEE-MAIN", "NEET", None, None]
    assert col(spark, ["[JEE Main 2019]", "x"], X.pyq_year) == [2019, None]
    assert col(spark, ["12", "x", None, ""], X.to_int) == [12, None, None, None]


def test_names(spark):
    assert col(spark, ["a/Chapter 15 - Probability.pdf", "Light & Glass!.pdf", "##.pdf", None], lambda c: X.bundle_name(c, F.lit("job"))) == ["Probability", "Light-Glass", "job", "job"]
    assert col(spark, ["(Class - IX)", "class 12 maths", "classic", None], X.class_name) == ["Class 9", "Class 12", None, None]
    assert col(spark, ["chapter-3-light-waves"], X.slug_title) == ["Light Waves"]
    assert col(spark, ["63b2759051009e3779b97f4b", "zz", None], X.id_stamp) == [0x63B27590 * 1000, 0, 0]
    assert col(spark, ["mongodb+srv://u:p@x@host/db", "abcdefghijklmnop", "short"], X.masked) == ["mongodb+srv://***@host/db", "abcd...mnop", "***"]
    assert one(spark, "1", X.stable_id("t", F.lit(None).cast("string")).alias("a"), X.stable_id("t", F.lit("")).alias("b")).a != one(spark, "1", X.stable_id("t", F.lit("")).alias("b")).b


def test_replies(spark):
    got = col(spark, ['{"kind":"formula","latex":"$x$"}', '```json\n{"kind":"Figure","latex":"x"}\n```', r"\(y\)", "", None, '{"kind":"odd"}', "{broken"], X.parse_reply)
    assert [(r.kind, r.latex) for r in got] == [("formula", "x"), ("figure", None), ("formula", "y"), ("formula", None), ("formula", None), ("blank", None), ("formula", "{broken")]


def test_python_functions(spark):
    assert col(spark, [r"\mathrm{a b}+\in\mathbf{R}", r"x^{\ast} \quad", r"\mathrm{~is~not~}", None], X.clean_latex) == [r"ab+\in R", "x*", r"\text{ is not }", None]
    assert col(spark, ["Ｐａｇｅ", "Q.l. x", "Q.1l. x", None], X.ocr_fix) == ["Page", "Q.1. x", "Q.11. x", None]


def test_guards(spark):
    assert col(spark, ["a\x1f", "ok", None], X.has_bad_chars) == [True, False, None]
    assert col(spark, [r"x_2", r"\(x_2\)", r"a\_b"], X.loose_scripts) == [True, False, False]
    assert col(spark, [r"\(a\)", r"\(a"], X.balanced_delimiters) == [True, False]
