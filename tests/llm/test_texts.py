import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import lookalike as L
from quillmark.llm import pair_defects as P
from quillmark.llm import scan_noise as S

STEM = "A sample of steel weighing 13.9 litres is placed inside a green reservoir. Find the slope when the tin part reaches 47 g."


@pytest.mark.parametrize(
    ("stem", "answer", "explanation", "want"),
    [
        (STEM, "", None, "empty"), (STEM, "...", "N/A", "empty"), (None, "", "Solution:", "empty"), (STEM, "B", "N/A", None), (STEM, "63.5", None, None), (STEM, r"\(x = 4\)", " ", None), (STEM, "A", "", None),
        (STEM, "", "I'm sorry, but I can’t help with this question. Please ask your teacher.", "refusal"), (STEM, "", "It cannot be determined from the fence alone. Refuse the smaller root and keep 5.", None),
        (STEM, "", "This request could not be completed. The idea of slope is best shown with a wheel.", "refusal"),
        (STEM, "", STEM, "copy"), (STEM, "", f"Ans. {STEM} {STEM.lower()}", "copy"), (STEM, "", f"We are told: {STEM[:74]} Thus the value is 4 newtons of tin and the ratio follows from the second relation above.", None),
        ("Define locus.", "Define locus. Define locus.", None, "copy"), ("Name the spare part.", "The question is: Name the spare part.", None, "copy"), (STEM, "", "Il reste donc 60 litres d'eau dans le récipient. La durée totale sera de 12 minutes.", "other_language"),
        (STEM, "", "Is prakar kul samay 66 minute hoga.", "other_language"), (STEM, "", "इस प्रकार कुल समय 98 मिनट होगा।", "other_language"), ("यदि तार लंबा हो तो भार बताइए।", "", "इस प्रकार कुल समय 98 मिनट होगा।", None),
        ("यदि तार लंबा हो तो भार बताइए।", "", "The total is 98 minutes and the answer is right.", "other_language"), ("यदि तार लंबा हो तो भार बताइए।", "98 m", None, None),
        (STEM, "", r"Dividing both sides by 4 gives \(x = ", "truncated"), (STEM, "", "The first part holds 4 g, while the", "truncated"), (STEM, "", "Both parts (see above", "truncated"), (None, None, None, "empty"),
    ],
)
def test_verdicts(stem, answer, explanation, want):
    assert P.verdict(stem, answer, explanation)[0] == want


def test_suffix_automaton_against_brute_force():
    a = "a b c d a b e f g".split()
    for text, least in (("a b c x a b e", 3), ("c d a b e f g", 3), ("x y", 2), ("a b", 2), ("g f e", 1)):
        w = text.split()
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        covered = {k for i in range(len(w)) for j in range(i + least, len(w) + 1) if tuple(w[i:j]) in runs for k in range(i, j)}
        assert P.SuffixAutomaton(a).coverage(w, least) == len(covered)


def test_truncation_learns_endings_from_the_corpus(spark):
    good = [(f"g{i}", STEM, "", f"By the rule for slope, the red lens and the tin leaf move together. Hence the required slope is {i}.5 newtons.") for i in range(30)]
    odd = [("full", STEM, "", "By the rule for slope, the red lens and the tin leaf move together. Hence the required slope is 7.1 newtons"), ("cut", STEM, "", "By the rule for slope, the red lens and the tin leaf move together. Hence the required"), ("word", STEM, "", "Hence the required slope is 7.1 newto"), ("twice", STEM, "", ""), ("twice", STEM, "", "By the rule"), (None, STEM, "", ""), ("null", None, None, None)]
    d = spark.createDataFrame(good + odd, "id string, stem string, answer string, explanation string")
    got = {r.id: r.defect for r in P.defects(d).collect()}
    assert got == {"cut": "truncated", "word": "truncated", "twice": "empty", "null": "empty"}
    assert P.defects(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("ｔｗｏ ｐａｒｔｓ， ＼（１５０６ ＋ 16p＼）", r"two parts, \(1506 + 16p\)"), ("Lómira", "Lómira"), ("ﬁlter oﬀ", "filter off"), ("a b c　d", "a b c d"), ("z​ero ﻿w­ord", "zero word"), ("right‑angled", "right-angled"),
        ("раrt οf the соrk, Αfter", "part of the cork, After"), ("А sample of steel", "A sample of steel"), (r"Here \(μ\) stays below 16°, x² and 5 μm, Ωm, π", None), ("Zürveld – “quoted” … ½ ™", None), ("क्‍ष और ज़", None), ("Привет мир", None), ("hν and ρgh", None), ("", None), ("plain", None),
    ],
)
def test_display(raw, want):
    assert L.display(raw) == (raw if want is None else want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_idempotent(t):
    d = L.display(t)
    assert L.display(d) == d and L.key(L.key(t)) == L.key(t)


@pytest.mark.parametrize(("raw", "want"), [("a\U0001d173b\U0001bca0c", "abc"), ("Ꭺpple ɡood", "Apple good"), ("Օne", "One"), ("/ɡɑ/", None), ("कि क़", None), ("か\u3099", "が"), ("приветк", None)])
def test_more_scripts(raw, want):
    assert L.display(raw) == (raw if want is None else want) and L.is_case(raw) == (want is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from(sorted(L._ODD))), max_size=12))
def test_the_key_finds_every_case(t):
    assert L.is_case(t) == (L.display(t) != t)


def test_cases_and_keys(spark):
    rows = [("a", "ｘ", None), ("a", "ｘ", None), ("b", "x y", "Straße"), ("c", None, ""), (None, "ｘ", "ｘ"), ("d", "30° α²", "é")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "id string, stem string, explanation string, extra int")
    assert {(r.id, r.field_name) for r in L.cases(d).collect()} == {("a", "stem"), ("b", "stem")}
    n = {r.id: r for r in L.normalised(d).collect()}
    assert n["b"].stem_key == "x y" and n["b"].explanation_key == "strasse" and n["c"].stem is None and n["c"].explanation_key == ""
    assert L.cases(d.limit(0)).count() == 0


def test_structure_repair():
    text = "Read the scale on the dam-\n12 | S t e p   S e q u e n c e s\naged right-\nangled lens. It is\nPage 4 of 9\nwet and the curve \\(a² -\n72x\\) fits.\nNext one."
    got, kinds = S.repair_lines(text, {"step sequences"}, {"right-angled"})
    assert got == "Read the scale on the damaged right-angled lens. It is wet and the curve \\(a² - 72x\\) fits.\nNext one."
    assert kinds == {"hyphen", "header", "page_number"}
    assert S.repair_lines("one line - 4", set(), set()) == ("one line - 4", set())
    assert S.repair_lines("Refuse the root and keep\n63", set(), set()) == ("Refuse the root and keep 63", set())
    assert S.repair_lines("a\nLight and Glass\nb", set(), set(), "Light and Glass")[1] == {"header"}
    assert S.repair_lines("a\nLight and Glass\nb", set(), set())[1] == set()
    assert S.repair_lines("", set(), set()) == ("", set())
    assert S.repair_lines("ab=\ncd unkn -\nown", set(), set())[0] == "abcd unknown"


def test_misread_words_are_decoded(spark):
    rows = [(f"g{i}", "The modern lens rests on the black floor beside the other drum.", "Turn the drum and read the lens.") for i in range(60)]
    rows += [("m1", "The rnodern 1ens rests on tbe b1ack fl0or.", None), ("m2", "The modern lens\n- 7 -\nrests on the bl-\nack floor.", ""), ("m3", None, None), ("m2", "The modern lens\n- 7 -\nrests on the bl-\nack floor.", "")]
    d = spark.createDataFrame([(i, None if i == "m3" else ("m", "c", "s"), s, e) for i, s, e in rows], "id string, path struct<module:string,chapter:string,section:string>, stem string, explanation string")
    got = {(r.id, r.field_name): (r.text, tuple(r.kinds)) for r in S.repaired(d).collect()}
    assert got["m1", "stem"] == ("The modern lens rests on the black floor.", ("misread",))
    assert got["m2", "stem"] == ("The modern lens rests on the black floor.", ("hyphen", "page_number"))
    assert got["g1", "stem"][1] == () and got["m2", "explanation"] == ("", ()) and ("m3", "stem") not in got
    assert len(got) == 60 * 2 + 1 + 2
    found = {(r.id, k) for r in S.repaired(d, every=False).collect() for k in r.kinds}
    assert found == {("m1", "misread"), ("m2", "hyphen"), ("m2", "page_number")}
    assert S.repaired(d.limit(0)).count() == 0


def test_channel_candidates():
    assert "modern" in S.candidates("rnodern") and "cyclist" in S.candidates("cychst") and "pulley" in S.candidates("pu11ey")
    assert "seconds" not in S.candidates("sceonds") and S.candidates("x" * 50) == {}
    assert "classified" in S.candidates("c1a$$1f1ed") and "classified" in S.candidates("c1a551f1cd") and "classified" not in S.candidates("c1a$$1f1ed", 1e-4)
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    assert long in S.candidates(long.replace("m", "rn", 1)) and S.candidates("ab1" * 30_000) == {}


def test_long_titles_and_formulae():
    title = "The Complete Companion to Motion on Straight Tracks and Curved Tracks " * 3
    assert S.repair_lines(f"a\n{title}\nb", {title.strip().casefold()}, set())[1] == {"header"}
    assert S._lm("see $" + "x + y " * 30 + "+ z$ and $tone or gla$$ here") == ["see", "\x01", "and", "$tone", "or", "gla$$", "here"]


_PIECE = st.sampled_from(["a", "lens", "Step Sequences", "Light and Glass", "well-", "known-", "b'c-", "right", "-", "word -", "- 7 -", "12", "", "Unit Tests | 4", "x y z-", "see well-", "known end.", "*a-", " pad-"])


@given(st.lists(_PIECE, max_size=9), st.sets(st.sampled_from(["step sequences", "light and glass", "unit tests"])), st.integers(0, 7))
@settings(max_examples=400, deadline=None)
def test_what_repair_looks_up_is_asked_for(lines, titles, pick):
    text = "\n".join(lines)
    compounds, seen = set(), set()

    class Recurring:
        """Compounds looked up: some are known."""

        def __contains__(self, w):
            seen.add(w)
            return (len(w) + pick) % 3 == 0

    S.repair_lines(text, titles, Recurring(), "Light and Glass")
    compounds = {w for w in seen if w in Recurring()}
    asked, parts = S.asked(text, "Light and Glass")[1], S.asked(text, "Light and Glass")[0]
    assert seen <= asked
    assert S.repair_lines(text, titles & parts, compounds & asked, "Light and Glass") == S.repair_lines(text, titles, compounds, "Light and Glass")


def test_two_occurrences_suffice_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 3, raising=False)
    head, cut = "Step Sequences 7\nthe lens rests", "a well-\nknown lens rests"
    rows = [("h1", head, None), ("h2", head, None), ("c1", cut, None), ("c2", "a well-known lens, a well-known drum", None)]
    rows += [(f"t{i}", f"Title {chr(65 + i)}pple\nthe lens rests", f"the odd{chr(97 + i)}-even lens") for i in range(20)]
    d = spark.createDataFrame([(i, None, s, e) for i, s, e in rows], "id string, path struct<module:string,chapter:string,section:string>, stem string, explanation string")
    found = {(r.id, k) for r in S.repaired(d, every=False).collect() for k in r.kinds}
    assert found == {("h1", "header"), ("h1", "page_number"), ("h2", "header"), ("h2", "page_number")}


@pytest.mark.parametrize("bits", [8, 1 << 24])
def test_a_field_gets_all_its_suspects_at_once(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "SHARD", 2, raising=False)
    monkeypatch.setattr(S, "BITS", bits, raising=False)
    rows = [(f"g{i}", "The modern lens rests on the black floor beside the other drum.", "Turn the drum and read the lens.") for i in range(60)]
    rows += [("m1", "The rnodern 1ens rests on tbe b1ack fl0or.", None), ("m2", "The modern lens\n- 7 -\nrests on the bl-\nack floor.", ""), ("m3", "Tbe\n- 7 -\nrnodern 1ens", "b1ack")]
    d = spark.createDataFrame([(i, None, s, e) for i, s, e in rows], "id string, path struct<module:string,chapter:string,section:string>, stem string, explanation string")
    got = [tuple(r) for r in S.repaired(d).select("id", "field_name", "text", "kinds").collect()]
    assert len(got) == len({r[:2] for r in got}) == 60 * 2 + 1 + 2 + 2 and all(r[2] is not None for r in got)
    want = {("m1", "stem"): "The modern lens rests on the black floor.", ("m2", "stem"): "The modern lens rests on the black floor.", ("m3", "stem"): "The modern lens", ("m3", "explanation"): "black"}
    assert {r[:2]: r[2] for r in got if r[:2] in want} == want
