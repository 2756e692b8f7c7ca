import os
import random

import numpy as np
import pytest

from quillmark.llm import canonical as C
from quillmark.llm import leaks as K
from quillmark.llm import packing as B
from quillmark.llm import private as V

CANON = [(1, "topic", "Sketching Bowl Curves", None), (2, "topic", "Motion on Straight Tracks", None), (3, "topic", "Motion on Curved Tracks", None), (4, "topic", "Unit Fractions of a Whole", None), (5, "exam", "BOARDS", None), (6, "exam", "JEE", None), (7, "pyqExam", "Utkarsh Scholarship Screening", "USS")]


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        ("topic", "sketching bowl curvees", 1), ("topic", "8. Sketching Bowl Curves [imp]", 1), ("topic", "SketchingBowlCurves", 1), ("topic", "Curves, Sketching Bowl", 1), ("topic", "Sketc. Bowl Curves", 1), ("topic", "Motion on Tracks", -1), ("topic", "Motion on Curvde Tracks", 3),
        ("topic", "Topic: Unit Fractions of a Whole", 4), ("topic", "Painting the light lens", -1), ("topic", "", -1), ("topic", "??", -1), ("exam", "  Boards", 5), ("exam", "J.E.E.", 6), ("exam", "Jee-Main", 6), ("exam", "na", -1),
        ("pyqExam", "USS '21", 7), ("pyqExam", "(uss)", 7), ("pyqExam", "Utkarsh Scholarship Screening Set B", 7), ("pyqExam", "school magazine", -1),
    ],
)
def test_mapping(field, value, want):
    m = C.Mapper([(i, t, s, 1) for i, f, t, s in CANON if f == field])
    r = m.find(value)
    assert (-1 if r is None else r) == want


def test_deletes_find_all_near_keys():
    rng = random.Random(2)
    keys = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 16))) for _ in range(300)}
    d = C.SymmetricDeletes(keys)
    pairs = 0
    for _ in range(400):
        w = list(rng.choice(sorted(keys)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            how = rng.randint(0, 3)
            if how == 0:
                w[k] = rng.choice("abcde")
            elif how == 1 and len(w) > 1:
                del w[k]
            elif how == 2:
                w.insert(k, rng.choice("abcde"))
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        q = "".join(w)
        want = {k for k in keys if C.edits(q, k) <= min(3, C.reach(max(len(q), len(k))))}
        pairs += len(want)
        assert {k for _, k in d.near(q)} == want and all(c == C.distance(q, k, 9) for c, k in d.near(q))
    assert pairs > 400


def test_blocks_settle_as_one_list(spark, monkeypatch):
    """Ties, word weights and short forms over blocks of one entry are those of the whole list."""
    rng = random.Random(5)
    words = "light lens drum curve motion track bowl unit whole section field wave".split()
    texts = list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(14)))
    canon = [(i, "topic", t.title(), "LL" if i in (2, 5) else f"S{i}" if i == 7 else None) for i, t in enumerate(texts)] + [(50, "topic", "Same Entry", None), (51, "topic", "Same Entri", None), (60, "exam", "BOARDS", None)]
    typed = ["Same Entr", "ll", "s7", "LL x", "boards"] + [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(40)] + [t[:4] + " " + t[-5:] for t in texts] + texts[:3]
    rows = [(f"q{i}", t, t if i % 7 == 0 else None, None) for i, t in enumerate(typed)] + [(f"x{i}", texts[4].title(), None, None) for i in range(3)]
    d = spark.createDataFrame(rows, "id string, topic string, exam string, pyqExam string")
    c = spark.createDataFrame(canon, "canon_id int, field_name string, canon_text string, short_form string")
    one = sorted(tuple(r) for r in C.mapped(d, c).collect())
    assert {("q0", "topic", -1), ("q1", "topic", -1), ("q2", "topic", 7)} <= set(one)
    monkeypatch.setattr(C, "BLOCK", 1)
    assert sorted(tuple(r) for r in C.mapped(d, c).collect()) == one


def test_mapped_rows(spark, monkeypatch):
    canon = spark.createDataFrame(CANON, "canon_id int, field_name string, canon_text string, short_form string")
    q = spark.createDataFrame([("a", "Sketching Bowl Curves", "board", None, 1), ("b", "sketching bowl curves", "BOARDS", "uss", 1), ("b", "sketching bowl curves", "BOARDS", "uss", 1), ("c", None, None, "xerox", 1), (None, "x", "x", "x", 1), ("d", "", "", "", 1)], "id string, topic string, exam string, pyqExam string, extra int")
    want = {("a", "exam", 5), ("b", "topic", 1), ("b", "pyqExam", 7), ("c", "pyqExam", -1), ("d", "topic", -1), ("d", "exam", -1), ("d", "pyqExam", -1)}
    assert {tuple(r) for r in C.mapped(q, canon).collect()} == want
    monkeypatch.setattr(C, "BLOCK", 3)
    assert {tuple(r) for r in C.mapped(q, canon).collect()} == want
    assert {r.canon_id for r in C.mapped(q, canon.limit(0)).collect()} == {-1} and C.mapped(q.limit(0), canon).count() == 0


def test_packing_is_whole_and_tight():
    rng = np.random.default_rng(4)
    for cap in (64, 512):
        sizes = rng.integers(1, cap + 1, 800).tolist()
        bins = B.pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(800)) and all(sum(sizes[i] for i in b) <= cap for b in bins)
        used = sorted(sizes, reverse=True)
        first_fit: list[int] = []
        for s in used:
            k = next((k for k, r in enumerate(first_fit) if r >= s), None)
            if k is None:
                first_fit.append(cap - s)
            else:
                first_fit[k] -= s
        assert len(bins) <= len(first_fit)
    assert B.pack([], 5) == [] and B.pack([5, 5], 5) == [[0], [1]]


@pytest.mark.skipif(not os.path.exists(B.TOKENIZER), reason="no tokenizer here")
def test_packed_rows(spark):
    docs = [(1, "word " * 50), (2, ""), (3, None), (4, "x " * 400), (5, "some more words here"), (6, " " * 9000 + "a" * 100_000)]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id bigint, text string, source string")
    caps = spark.createDataFrame([(1, 128), (2, 0), (3, None)], "capacity_id int, n_tokens int")
    got = B.packed(d, caps).collect()
    size = dict(zip([i for i, _ in docs], B.count_tokens([t for _, t in docs])))
    for i, n in size.items():
        own = sorted((r.piece, r.token_from, r.piece_tokens) for r in got if r.doc_id == i)
        assert sum(p for _, _, p in own) == n and [f for _, f, _ in own] == [128 * k for k in range(max(1, len(own)))]
        assert len(own) == max(1, -(-n // 128))
    room: dict = {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.piece_tokens
    assert max(room.values()) <= 128 and {r.capacity_id for r in got} == {1}
    assert B.packed(d.limit(0), caps).count() == 0 and B.packed(d, caps.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(B.TOKENIZER), reason="no tokenizer here")
def test_long_blanks_are_sized_as_the_tokenizer_does(monkeypatch):
    enc = B.encoder(B.TOKENIZER)
    rng = random.Random(3)
    monkeypatch.setattr(B, "_LONG_BLANK", B.re.compile(r"\s{5,}"))
    for _ in range(300):
        t = "".join(rng.choice(["word", " ", " " * 7, "\n" * 6, "\t \n" * 3, "x1", "'s", ".", "\u3000" * 5, " \r\n" * 4]) for _ in range(rng.randint(1, 9)))
        assert B._count(enc, t) == len(enc.encode_ordinary(t)), t


def test_many_empty_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_DOCS", 10)
    d = spark.createDataFrame([(i, "") for i in range(200)], "doc_id bigint, text string")
    got = B.packed(d, spark.createDataFrame([(1, 128)], "capacity_id int, n_tokens int")).groupBy("container").count().collect()
    assert sum(r["count"] for r in got) == 200 and len(got) >= 10 and max(r["count"] for r in got) < 40


def passage(rng, vocab, item, share, changed):
    n = len(item)
    length = int(np.ceil(share * n))
    at = rng.randrange(n - length + 1)
    part = item[at : at + length]
    for k in rng.sample(range(1, length - 1), int(changed * length)):
        part[k] = "zzz"
    return part


def longest(item, doc):
    best = 0
    for d in range(-len(item), len(doc)):
        same = [0 <= d + p < len(doc) and doc[d + p] == w for p, w in enumerate(item)]
        for a in range(len(item)):
            bad = 0
            for b in range(a, len(item)):
                bad += not same[b]
                if bad <= 0.1 * (b - a + 1) + 1e-9:
                    best = max(best, b - a + 1)
    return best


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 70)))) for i in range(12)]
    docs = []
    for d in range(60):
        noise = [rng.choice(vocab) for _ in range(rng.randint(20, 300))]
        if d % 2:
            item = rng.choice(items)[1].split()
            at = rng.randrange(len(noise))
            noise[at:at] = passage(rng, vocab, item, rng.choice([0.3, 0.42, 0.55, 0.7, 1.0]), rng.choice([0, 0.05, 0.1]))
        text = " ".join(w + rng.choice(["", ",", ".\n", "”"]) for w in noise)
        docs.append((d, text.upper() if d % 5 == 0 else text))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (103, "few words")]
    want = {(d, i) for d, t in docs if t for i, x in items if longest(K.words_of(x), K.words_of(t)) >= 0.5 * len(K.words_of(x))}
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, source string")
    it = spark.createDataFrame([*items, (50, None), (51, "")], "item_id int, text string")
    got = {tuple(r) for r in K.leaks(df, it).collect()}
    assert got == want and len(want) > 10
    assert K.leaks(df, it.limit(0)).count() == 0 and K.leaks(df.limit(0), it).count() == 0


def test_short_items_and_long_documents():
    known: dict = {}
    h = lambda t: K.hashes(K.words_of(t), known)
    items = K.Items([(1, "only four words here"), (2, " ".join(f"k{i}" for i in range(40)))])
    long = " ".join(f"n{i}" for i in range(70_000))
    docs = [h("x only four words, here y"), h("only four words"), h(long + " " + " ".join(f"k{i}" for i in range(25))), h(long)]
    assert K.found_in(docs, items) == [(0, 1), (1, 1), (2, 2)]  # three of four words are half of them and more


PII = [
    ("My name is Delna Holwecade and I am stuck.", [("name", "Delna Holwecade")]), ("Thanks,\nU. Prasdelock\nMob. +44 7700 900653", [("name", "U. Prasdelock"), ("phone", "+44 7700 900653")]), ("Answered by: Fenmone, Lumura I live at 134 Station Road,\nVasmira 000260.", [("name", "Fenmone, Lumura"), ("address", "134 Station Road,\nVasmira 000260")]),
    ("Mr. sonand tarvade says the dial is wet.", [("name", "sonand tarvade")]), ("The Head Examiner and the Key Team sign. Green Valley Press printed 8046 copies.", []), ("Write (<jana91 [at] northdesk [dot] example>) or jo(at)desk.example.", [("email", "jana91 [at] northdesk [dot] example"), ("email", "jo(at)desk.example")]),
    ("closed on Tuesday at 5 pm @ gate 63", []), ("Roll/ID: 0343-8255-9791", [("id_number", "0343-8255-9791")]), ("Card 0674 0613 7802 is expired.", [("id_number", "0674 0613 7802")]), ("Tax id CAND/2018/103201 and X0152019", [("id_number", "CAND/2018/103201"), ("id_number", "X0152019")]), ("Table 50.48: 3941 3301 1126 75 27 32.5 readings in litres", []), ("About 3270765876 grains of lead", []),
    ("Ring 415.555.0140 (2180386875)", [("phone", "415.555.0140"), ("phone", "2180386875")]), ("string for part 84 is 08684 351 4829, read across", []), ("sheet 88-4517-1763-0 lists", []), ("Take 2638 - 5784 - 8382 and round the sum", []), ("H.No. 18/9, Saffron Marg, Torford - 000 167 is full", [("address", "H.No. 18/9, Saffron Marg, Torford - 000 167")]), ("The Melmira Lane bridge problem uses 38 pillars", []), ("Paper code 98/7544/8 replaces", []), ("", []),
]


@pytest.mark.parametrize(("text", "want"), PII)
def test_detection(text, want):
    assert sorted((k, text[a:b]) for a, b, k in V.find(text)) == sorted(want)


LOCAL, HOST = "a" * 150, ".".join(f"part{i}" for i in range(40))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"Write to {LOCAL}@{HOST}.example now", [("email", f"{LOCAL}@{HOST}.example")]), ("x at a" + " dot bc" * 30, [("email", "x at a" + " dot bc" * 30)]), ("Live at 12 Lake\nRoad, Pune 411 001.", [("address", "12 Lake\nRoad, Pune 411 001")]),
        ("It was signed\nby Delna Holwecade.", [("name", "Delna Holwecade")]), ("Dr. R. Mehta said so", [("name", "R. Mehta")]), ("see -Mr Ravi Rao there", [("name", "Ravi Rao")]), (f"Signed by Delna {'M' + 'o' * 200}.", [("name", "Delna M" + "o" * 200)]),
        ("मेरा नाम रवि शर्मा है। श्री अनिल वर्मा ने कहा।", [("name", "अनिल वर्मा"), ("name", "रवि शर्मा")]), ("छात्र: नेहा गुप्ता, मकान नं. 12, गांधी मार्ग, पुणे - 411001 पर", [("address", "मकान नं. 12, गांधी मार्ग, पुणे - 411001"), ("name", "नेहा गुप्ता")]),
        ("My name is Anita Desai. Yesterday Anita Desai brought the lens.", [("name", "Anita Desai"), ("name", "Anita Desai")]), ("Thanks,\nGreen Valley School", []), ("Student: Ridge Hollow Press said so", []), ("Sent by Ravi Rao" + " and then some words" * 4000, [("name", "Ravi Rao")]),
    ],
)
def test_detection_without_gaps(text, want):
    assert sorted((k, text[a:b]) for a, b, k in V.find(text)) == sorted(want)


def test_entities():
    got = V.entities_of_names(["Ravi Sharma", "R. Sharma", "SHARMA, RAVI", "Sharma", "Ravi K. Sharma", "K. Mehta", "Mehta", "A. Rao", "Asha Rao", "Amit Rao"])
    assert {got[n] for n in ("Ravi Sharma", "R. Sharma", "SHARMA, RAVI", "Sharma", "Ravi K. Sharma")} == {"ravi sharma"}
    assert got["K. Mehta"] == "k mehta" and got["A. Rao"] == "a rao" and got["Asha Rao"] != got["Amit Rao"]
    assert V.entity_of("phone", "+91 98765 43210") == V.entity_of("phone", "98765 43210") == V.entity_of("phone", "098765-43210")
    assert V.in_format("phone", "+91 98765 43210", "111222333") == "+91 91112 22333"
    assert V.in_format("name", "R. K. Sharma", "milo zand", "ravi sharma")[:3] == "M. " and V.in_format("name", "sharma, r.", "milo zand", "ravi sharma") == "zand, m."
    assert V.in_format("name", "SHARMA", "milo zand", "ravi sharma") == "ZAND"


def test_gender_is_learned():
    e = V.Endings([("asha", "f"), ("nisha", "f"), ("mira", "f"), ("rohan", "m"), ("kiran", "m"), ("arun", "m")])
    assert e.of("elisha") == "f" and e.of("varun") == "m" and e.of("zzz") is None and V.Endings([]).of("asha") is None


def test_surrogates(spark):
    rows = [(1, "Mail me at jo.ann@desk.example. Thanks,\nAsha Lamlide\nPh: 415.555.0140"), (2, "As Lamlide, Asha pointed out, ring 415-555-0140? Ring 415.555.0140. Student: Asha Lamlide"), (3, None), (4, "nothing here"), (5, "Thanks,\nRohan Venrivik"), (5, "Thanks,\nRohan Venrivik"), (6, "Ask for Mrs. Nisha Holmo. Ask for Mr. Arun Calso."), (5, "Student: Rohan Venrivik, a longer text of the same id"), (7, "Student: Asha Lamlide. Thanks,\nA. Lamlide"), (8, "")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string")
    out = V.replaced(d, "k").collect()
    got = {r.doc_id: r.text for r in out if r.doc_id != 5}
    assert len(out) == len(rows) and got[8] == ""
    assert got[3] is None and got[4] == "nothing here" and "Lamlide" not in got[1] + got[2] + got[7] and "0140" not in got[1]
    import re

    one = re.search(r"\[NAME:(\w+) (\w+)\]", got[1]).groups()
    other = re.search(r"\[NAME:(\w+), (\w+)\]", got[2]).groups()
    assert one == (other[1], other[0]) and one[0][-1] in "aei" and f"[NAME:{one[0]} {one[1]}]" in got[2]
    assert got[7] == f"Student: [NAME:{one[0]} {one[1]}]. Thanks,\n[NAME:{one[0][0]}. {one[1]}]"
    phone = re.search(r"\[PHONE:(\d{3}\.\d{3}\.\d{4})\]", got[1])[1]
    assert f"[PHONE:{phone}]" in got[2] and got[1].startswith("Mail me at [EMAIL:") and got[1].split("]")[1] == ". Thanks,\n[NAME:" + " ".join(one)
    five = sorted(r.text for r in out if r.doc_id == 5)
    name = re.search(r"\[NAME:[^\]]+\]", five[0])[0]
    assert five == sorted([f"Thanks,\n{name}"] * 2 + [f"Student: {name}, a longer text of the same id"]) and "Venrivik" not in name
    assert V.replaced(d.limit(0), "k").count() == 0
    again = {r.doc_id: r.text for r in V.replaced(d, "k").collect() if r.doc_id != 5}
    assert again == got != {r.doc_id: r.text for r in V.replaced(d, "other").collect() if r.doc_id != 5}
    assert V.secret_of(d) == V.secret_of(d.repartition(3)) != V.secret_of(d.limit(4)) and len(V.secret_of(d.limit(0))) == 64


def test_digit_cipher_is_a_permutation():
    out = {V._digits(b"k", "phone", f"{i:04d}") for i in range(10_000)}
    assert len(out) == 10_000 and all(len(x) == 4 for x in out)
    assert V.in_format("phone", "(415) 555-01", "98765432") == "(987) 654-32"
    assert V.in_format("name", "LAMLIDE, ASHA", "mira sol", "asha lamlide") == "SOL, MIRA"


def test_collisions_draw_again(spark, monkeypatch):
    f = spark.createDataFrame([("name", f"person{chr(97 + i)} one", None) for i in range(6)], "pii_type string, entity string, gender string")
    real = V.surrogate
    monkeypatch.setattr(V, "surrogate", lambda s, k, e, t, g: "same" if t == 0 else "persona one" if t == 1 else real(s, k, e, t, g))
    m = V.mapping(f, "k").collect()
    # all but one of "same" draw again; all that drew a real entity do so once more
    assert len({r.surrogate for r in m}) == 6 and "persona one" not in {r.surrogate for r in m} and sorted(r.turn for r in m) == [0, 2, 2, 2, 2, 2]


@pytest.mark.parametrize(("n", "part", "changed"), [(58, 30, (7, 15, 22)), (18, 10, (4,)), (78, 40, (8, 16, 24, 32))])
def test_longer_passages_may_keep_fewer_shingles(n, part, changed):
    known = {}
    item = [f"word{i}" for i in range(n)]
    got = [f"other{i}" if i in changed else w for i, w in enumerate(item[:part])]
    doc = [f"before{i}" for i in range(40)] + got + [f"after{i}" for i in range(40)]
    items = K.Items([(1, " ".join(item))])
    assert longest(item, doc) >= 0.5 * n
    assert items.need[0] <= len({tuple(item[i : i + 5]) for i in range(n - 4)} & {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)})
    d, w = K.hashes(doc, known), K.hashes(item, known)
    assert K.verified(d, K.shingles(d), 0, len(d), w, items.grams[0], items.need[0])


def reaches(item, doc):
    """Whether some stretch that begins with a right word holds half of the item."""
    for d in range(-len(item), len(doc)):
        same = [0 <= d + p < len(doc) and doc[d + p] == w for p, w in enumerate(item)]
        for a in (p for p, x in enumerate(same) if x):
            bad = 0
            for b in range(a, len(item)):
                bad += not same[b]
                if bad <= 0.1 * (b - a + 1) + 1e-9 and b - a + 1 >= 0.5 * len(item):
                    return True
    return False


@pytest.mark.parametrize("words", [(1, 9), (10, 19), (20, 45), (5, 120)])
def test_items_of_any_length_against_brute_force(words):
    rng = random.Random(words[1])
    vocab = [f"v{i}" for i in range(60 if words[1] < 10 else 400)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(*words))] for _ in range(12)]
    index = K.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    known: dict = {}
    docs = []
    for _ in range(25):
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        for item in rng.sample(items, 2):
            part = item[(k := rng.randrange(len(item))) :][: rng.randint(1, len(item))]
            for c in rng.sample(range(len(part)), min(len(part), rng.choice((0, 0, 1, 3)))):
                part = [*part[:c], "zz", *part[c + 1 :]]
            doc[(at := rng.randrange(len(doc) + 1)) : at] = part
            doc = doc if k % 3 else [*item[: -(-len(item) // 2)], *doc]
        docs.append(doc)
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if reaches(item, doc)}
    got = set(K.found_in([K.hashes(d, known) for d in docs], index))
    # long items go by MinHash, which passes over a pair with the least containment once in 500 times
    assert want and got <= want and len(want - got) <= (len(want) // 100 if words[1] > 45 else 0)


def test_item_blocks_change_nothing(spark, monkeypatch):
    item = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((60, 12, 4, 80))]
    docs = spark.createDataFrame([(0, " ".join(item[0].split()[:40])), (1, item[1] + " more"), (2, "so " + item[2]), (3, item[3] + " " + item[0]), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(9, None)], "item_id int, text string")
    whole = {tuple(r) for r in K.leaks(docs, items).collect()}
    assert whole == {(0, 0), (1, 1), (2, 2), (3, 0), (3, 3)}
    monkeypatch.setattr(K, "BLOCK", 1)
    assert {tuple(r) for r in K.leaks(docs, items).collect()} == whole
    assert K.leaks(docs, items.limit(0)).count() == 0 and K.leaks(docs.limit(0), items).count() == 0
