"""Problem 2: broken question and response pairs.

One row per defective id with its defect. Per pair, in Python over Arrow batches:

* ``empty`` - neither field says anything beyond filler;
* ``refusal`` - an Aho-Corasick automaton over refusal phrases, and most of the response lies in sentences that hold
  one or that only close such a reply;
* ``copy`` - a suffix automaton over the stem's words is traversed with the response's words; runs of the stem must
  cover nearly all of the response;
* ``other_language`` - script shares and stopword votes of stem and response differ;
* ``truncated`` - a delimiter stack finds an open formula or bracket, or the last sentence has no end mark and does
  not read like an ended one.

The last test needs the corpus: one pass counts, over all responses, the shapes of ended sentences and how often a
run of tokens is followed by an end (pre-aggregated per task, then summed). Only pairs still undecided join those
counts, by hash, so nothing is broadcast and nothing is collected.

Cases: null or blank fields are empty; a bare label, number or formula in ``answer`` is a proper response; rows that
share an id give one defect (the first in the order of ``DEFECTS``); null ids are left out; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.lookalike import display
from quillmark.llm.scan_noise import repair_lines
from quillmark.runtime import table

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

#: Words that alone say nothing in a response field.
FILLER = frozenset("n/a na nil none null nan ans answer answers solution sol soln explanation explain tbd todo pending blank empty hint working see below उत्तर हल".split())

#: Fixed phrases of replies that decline (case-folded, plain apostrophes).
REFUSALS = (
    "can't help", "cannot help", "can not help", "can't assist", "cannot assist", "can't answer", "cannot answer", "can't solve", "cannot solve this",
    "can't provide", "cannot provide", "can't share", "cannot share", "unable to solve", "unable to answer", "unable to help", "unable to assist",
    "unable to provide", "unable to complete", "unable to respond", "am unable to", "not able to answer", "not able to solve", "not able to help",
    "were not able to", "was not able to", "am not able to", "won't be able to", "will not be able to", "must decline", "have to decline", "declined to",
    "decline to answer", "decline to work", "i decline", "beyond what i can", "beyond my ability", "beyond my capabilities", "guidelines prevent",
    "guidelines do not allow", "policy prevents", "against my guidelines", "could not be completed", "cannot be completed", "can't be completed",
    "could not be processed", "do not have enough information", "don't have enough information", "not have sufficient information", "not something we are allowed",
    "not something i am allowed", "not allowed to share", "not allowed to answer", "not permitted to", "no solution will be provided", "no answer will be provided",
    "will not be provided", "no working can be given", "no answer can be given", "no solution can be given", "cannot be given for this", "as an ai", "as a language model",
    "as an automated assistant", "as an assistant, i", "i refuse", "refuse to answer", "refuse to help", "i'd rather not", "i would rather not", "cannot comply", "can't comply",
)

#: Sentences that only close a refusal.
CLOSERS = re.compile(
    r"^(please (ask|consult|contact|try|refer|upload)|kindly (ask|consult|contact|refer)|try (again|uploading)|you (may|can|could) (rephrase|try|ask|consult)|i hope you understand|thank you|thanks|sorry|apologies|i apologi[sz]e|we apologi[sz]e)\b", re.I
)

#: Function words that vote for a language (romanised Hindi apart from Devanagari Hindi).
STOPWORDS = {
    "en": "the a an of in is are was were be been to and or that this these those it its for on at with as by from not than so we our you i if when while which what how each every per all into there here then thus hence therefore because since both more only on after before before let us has have had can cannot must do does will would should but no one two same such between during get gives given show find".split(),
    "fr": "le la les l un une des du de et est sont était à au aux en que qui dans sur pour par avec sans ce cette ces il elle on nous vous donc ainsi alors comme sa son ses leur mesure reste lors où d d'abord deux membres".split(),
    "de": "der die das den dem des ein eine einen einem eines und ist sind war in im zu zum zur von vom mit auf für durch nicht auch als also so sich es er sie wir da wenn dann damit seine ihre beide bleiben aus an bei teilt man".split(),
    "es": "el la los las un una unos unas de del y es son era en que por para con sin se su sus lo al como entonces según tanto ambos entre este esta queda quedan resulta más será si cuando donde".split(),
    "pt": "o a os as um uma de do da dos das e é são em no na que por para com sem se seu sua ao como então ambos entre este esta".split(),
    "it": "il lo la i gli le un una di del della dei e è sono in nel che per con senza si suo sua al come allora entrambi tra questo questa".split(),
    "hi-Latn": "is prakar tarah liye hai hain ka ki ke ko se mein me par aur ya jo yeh ye woh wo uska uski iska iski isliye kul hoga hogi hota hoti tha thi the na nahi diye gaye gaya dono ek kya kaise yahan wahan humein hume hum aap raha rahta rehta bacha aata milta par tak".split(),
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)

#: Words kept in a sentence's shape; every other word becomes one open slot.
KEPT = frozenset(w for ws in STOPWORDS.values() for w in ws) | frozenset("और का की के को से में पर है हैं हम यह इस उस तो ही भी होगा होगी था थी कि जो अतः इसलिए".split())

#: Copied share of the response's words that makes it a repeat; shortest run of the stem that counts.
COPIED, RUN = 0.85, 3
#: A shape seen this often as an ended sentence ends a response without its full stop, as does a tail of
#: tokens that is followed by an end in at least half of its occurrences.
SEEN, ENDS = 3, 0.5

_DEVA = re.compile(r"[ऀ-ॿ]+")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*", re.U)
_TOKEN = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\$[^$]+\$|[ऀ-ॿ]+|[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]", re.S)
_SENT = re.compile(r"(?<=[.!?।])[\"”')\]]*\s+")
_UNIT = r"(?:[^\W\d_]{1,12}\.?|°|%)"
_NUM = r"[-+]?\d+(?:[.,]\d+)*"
_VALUE = re.compile(rf"^\(?(?:[A-Ha-h]|[ivx]{{1,4}}|{_NUM}(?:\s*{_UNIT}(?:\s*/\s*{_UNIT})?)?|{_NUM}\s*[:/]\s*{_NUM}|true|false|yes|no|सत्य|असत्य)\)?[.]?$", re.I)
_FORMULA = re.compile(r"^(?:\\\(.*\\\)|\\\[.*\\\]|\$[^$]+\$)[.]?$", re.S)


def clean(text: str | None) -> str:
    """Ordinary characters, without page numbers, spaced-out headers and line-break hyphens, single spaces."""
    if not text:
        return ""
    if not text.isascii():
        text = display(text)
    if "\n" in text:
        text = repair_lines(text, (), ())[0]
    return " ".join(text.split())


def is_filler(text: str) -> bool:
    """Nothing but filler words and marks."""
    t = text.casefold()
    if not any(c.isalnum() for c in t):
        return not (t and _FORMULA.match(t))
    return all(w.strip(".,:;-_()[]!*=") in FILLER or not any(c.isalnum() for c in w) for w in t.split())


class SuffixAutomaton:
    """Suffix automaton over the words of one prompt."""

    __slots__ = ("link", "length", "move")

    def __init__(self, words: list[str]) -> None:
        self.link, self.length, self.move = [-1], [0], [{}]
        link, length, move = self.link, self.length, self.move
        last = 0
        for w in words:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            move.append({})
            p = last
            while p >= 0 and w not in move[p]:
                move[p][w] = cur
                p = link[p]
            if p >= 0:
                q = move[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    move.append(dict(move[q]))
                    while p >= 0 and move[p].get(w) == q:
                        move[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def coverage(self, words: list[str], least: int) -> int:
        """How many of the words lie in runs of at least ``least`` words that the prompt holds."""
        state = run = covered = until = 0
        for i, w in enumerate(words):
            while state and w not in self.move[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.move[state]:
                state = self.move[state][w]
                run += 1
            else:
                run = 0
            if run >= least:
                covered += i + 1 - max(until, i + 1 - run)
                until = i + 1
        return covered


_PLAIN = re.compile(r"[^\w\s]+|_+")


def copy_words(text: str) -> list[str]:
    return _PLAIN.sub(" ", text.lower()).split()


_LABELS = frozenset(("ans", "answer", "sol", "solution", "soln", "explanation"))


#: An opening without figures or an end of its own: "The question is: ...".
_LEAD_IN = re.compile(r"^[^:.?!\d\\]+:\s+(?=\S)")


def is_copy(stem: str, response: str) -> bool:
    """Whether the response only repeats the stem. A lead-in that is no longer than what follows does not count."""
    r = copy_words(response)
    if m := _LEAD_IN.match(response):
        rest = copy_words(response[m.end() :])
        if 2 * len(rest) >= len(r):
            r = rest
    while r and r[0] in _LABELS:
        r = r[1:]
    s = copy_words(stem)
    if not r or not s or len(r) == 1:
        return bool(r) and r == s
    known = set(s)
    if sum(w in known for w in r) < COPIED * len(r):  # an upper bound of what the automaton can find
        return False
    return SuffixAutomaton(s).coverage(r, min(RUN, len(r), len(s))) >= COPIED * len(r)


def _refusals() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


_AUTOMATON = _refusals()


def is_refusal(text: str) -> bool:
    """The response opens with a refusing sentence and little follows, or refusing sentences and their closers
    make up at least half of it."""
    t = text.lower().replace("’", "'").replace("‘", "'")
    if next(_AUTOMATON.iter(t), None) is None:
        return False
    own = rest = others = 0
    opens = False
    for n, s in enumerate(_SENT.split(t)):
        if next(_AUTOMATON.iter(s), None) is not None or CLOSERS.match(s):
            own += len(s)
            opens |= n == 0
        else:
            rest += len(s)
            others += 1
    return own >= rest or (opens and others <= 2)


_EN = frozenset(STOPWORDS["en"])


def language(text: str) -> tuple[str | None, int]:
    """The language with most votes, and its lead over the next; (None, 0) where nothing votes."""
    if not text.isascii():
        deva = sum(map(len, _DEVA.findall(text)))
        if deva >= 3 and deva > sum(map(len, _LATIN.findall(text))):
            return "hi", deva
    words = _WORD.findall(text.lower())
    en = sum(map(_EN.__contains__, words))
    if en >= 3 and 4 * en >= len(words):
        return "en", en
    votes: dict[str, int] = defaultdict(int)
    for w in words:
        for lang in _VOTES.get(w, ()):
            votes[lang] += 1
    if not votes:
        return None, 0
    ranked = sorted(votes.items(), key=lambda x: (-x[1], x[0] != "en", x[0]))
    return ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0)


def votes_for(lang: str, text: str) -> int:
    return sum(lang in _VOTES.get(w, ()) for w in _WORD.findall(text.lower()))


def is_value(text: str) -> bool:
    return bool(_VALUE.match(text) or _FORMULA.match(text))


_DELIM = re.compile(r"\\[()\[\]]")
_OPENS = {"\\)": "\\(", "\\]": "\\["}


def open_delimiters(text: str) -> bool:
    """Whether a formula or bracket is still open at the end."""
    stack: list[str] = []
    for d in _DELIM.findall(text):
        if d not in _OPENS:
            stack.append(d)
        elif stack and stack[-1] == _OPENS[d]:
            stack.pop()
    if stack or text.endswith("\\"):
        return True
    return text.count("(") > text.count(")") and text.rfind("(") > text.rfind(")")


def has_end(text: str) -> bool:
    """Whether the text closes with an end mark, perhaps within quotes or brackets."""
    return text.rstrip("\"”'’)]")[-1:] in (".", "!", "?", "।")


def _slot(t: str) -> str:
    c = t[0]
    if c.isdigit():
        return "9"
    if c in "\\$" and len(t) > 1:
        return "F"
    if c.isalpha() or "ऀ" <= c <= "ॿ":
        return t if t in KEPT else "_"
    return c if c in ",;:" else "_" if c == "°" else ""


def shape(sentence: str) -> list[str]:
    """A sentence as kept words, open slots, numbers and marks."""
    return [x for x in map(_slot, _TOKEN.findall(sentence.lower())) if x]


def _h(kind: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + what) - (1 << 63)


def tail_keys(text: str) -> list[int]:
    """Keys of an unended response's last sentence: whole shape, last four tokens, last three, and the last word, where
    it ends in one."""
    last = _SENT.split(text)[-1]
    s = shape(last)
    word = (_TOKEN.findall(last.lower()) or [""])[-1]
    return [_h("f", " ".join(s)), _h("4", " ".join(s[-4:])), _h("3", " ".join(s[-3:])), *([_h("w", word)] if _is_word(word) else [])]


def _is_word(token: str) -> bool:
    return token[:1].isalpha() or "ऀ" <= token[:1] <= "ॿ"


def verdict(stem: str | None, answer: str | None, explanation: str | None) -> tuple[str | None, list[int] | None]:
    """(defect, None), or (None, keys) where the corpus must decide, or (None, None) for a sound pair."""
    a, e = clean(answer), clean(explanation)
    if is_filler(e) and is_filler(a):
        return "empty", None
    r = e or a
    if is_filler(r) or is_value(r):
        return None, None
    if is_refusal(r):
        return "refusal", None
    s = clean(stem)
    if s and is_copy(s, r):
        return "copy", None
    if s:
        lang, lead = language(r)
        if lang is not None and lang != (own := language(s)[0] or "en"):
            # a clear lead, or several votes and none for the stem's own language
            if lead >= 2 or lang == "hi" or (lead and votes_for(own, r) == 0 and votes_for(lang, r) >= 2):
                return "other_language", None
    if open_delimiters(r):
        return "truncated", None
    if has_end(r):
        return None, None
    if r[-1] in ",;:-=+<>/(" or r.endswith((" and", " the", " of", " or")):
        return "truncated", None
    return None, tail_keys(r)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, s, a, e in zip(*(c.to_pylist() for c in b.columns)):
            defect, keys = verdict(s, a, e)
            if defect or keys:
                # a decided pair passes the join on a key of its own, so that such pairs spread over all tasks
                out.append((i, defect, keys or [_h("decided", i)]))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64()))], names=["id", "defect", "keys"])


class _Slots(dict):
    """Remembers the slot of each token."""

    def __missing__(self, t: str) -> str:
        v = self[t] = _slot(t)
        return v


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each shape ends a sentence, each run of tokens is followed by an end or not, each word occurs.
    Sentences of one shape are counted together, so runs are cut once per shape."""
    whole: Counter[str] = Counter()
    loose: Counter[str] = Counter()
    words: Counter[str] = Counter()
    slots = _Slots()

    def flush() -> pa.RecordBatch:
        ends: Counter[str] = Counter()
        mids: Counter[str] = Counter()
        for of, done in ((whole, True), (loose, False)):
            for sentence, n in of.items():
                t = sentence.split(" ")
                for i in range(3, len(t)):
                    mids["3" + " ".join(t[i - 3 : i])] += n
                    if i > 3:
                        mids["4" + " ".join(t[i - 4 : i])] += n
                if done:
                    ends["f" + sentence] += n
                    ends["4" + " ".join(t[-4:])] += n
                    ends["3" + " ".join(t[-3:])] += n
        for w, n in words.items():
            if _is_word(w):
                mids["w" + w] += n
        keys = list(ends.keys() | mids.keys())
        for c in (whole, loose, words, slots):
            c.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([_h(k[0], k[1:]) for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([mids[k] for k in keys], pa.int64())], names=["key", "e", "m"]
        )

    for b in batches:
        for a, e in zip(*(c.to_pylist() for c in b.columns)):
            r = clean(e) or clean(a)
            for sentence in _SENT.split(r.lower()):
                tokens = _TOKEN.findall(sentence)
                s = " ".join(filter(None, map(slots.__getitem__, tokens)))
                if " " not in s:
                    continue
                if has_end(sentence):
                    whole[s] += 1
                    words.update(tokens)
                else:
                    loose[s] += 1
                    words.update(tokens[:-1])
        if len(whole) + len(loose) + len(words) > 400_000:
            yield flush()
    yield flush()


def defects(questions: DataFrame) -> DataFrame:
    """(id, defect), one row per defective id."""
    q = questions.select("id", "stem", "answer", "explanation").where("id is not null")
    judged = q.mapInArrow(_judge, "id string, defect string, keys array<bigint>").distinct()
    names = F.array(*map(F.lit, DEFECTS))
    counts = questions.select("answer", "explanation").mapInArrow(_count, "key bigint, e bigint, m bigint").groupBy("key").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    ask = judged.select("id", "defect", F.col("keys").alias("of"), F.posexplode("keys").alias("level", "key"))
    got = ask.join(counts, "key", "left").groupBy("id", "defect", "of").agg(*(F.coalesce(F.max(F.when(F.col("level") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(4) for c in ("e", "m")))
    known_word = F.col("m3") >= SEEN
    whole = F.col("e0") >= SEEN
    four = F.col("e1") + F.col("m1")
    three = F.col("e2") + F.col("m2")
    tail = F.when(four >= SEEN, F.col("e1") >= ENDS * four).when(three >= SEEN, F.col("e2") >= ENDS * three).otherwise(F.lit(False))
    number = F.size("of") == 3
    ended = (known_word | number) & (whole | tail)
    rank = F.when(F.col("defect").isNotNull(), F.array_position(names, F.col("defect"))).when(~ended, len(DEFECTS))
    return got.select("id", rank.cast("int").alias("rank")).where("rank is not null").groupBy("id").agg(F.min("rank").alias("rank")).select("id", F.element_at(names, F.col("rank")).alias("defect"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "question").select("id", "stem", "answer", "explanation"))
