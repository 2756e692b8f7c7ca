"""Problem 8: personal information inside free text - detection and keyed surrogates.

Detection reads each text once: e-mail addresses however written, phone numbers by shape (weak shapes only next to a
cue), identity numbers by shape or cue, street addresses from the house part to place or postal code, and names of
persons by cue words, titles, sign-offs and what persons do; a full name found once is found wherever else it stands
in the document. Stronger kinds claim their characters first. Patterns run only around the words they cannot do
without, in windows of whole words that hold any match of the pattern; a match near a window's end runs again in a
longer one.

Entities: names irrespective of case and order, middle initials left out; a name with initials, or a part of a name,
is the one full name of its document that it fits; phone numbers by their last nine digits, whatever country or area
code stands before; other numbers by their characters, addresses and e-mails by their letters.

Surrogates: every distinct entity gets one replacement keyed by HMAC, of the same type, script and format, so that
texts stay readable and mentions of one entity stay mentions of one entity. Digits go through a keyed permutation;
names, streets and mailboxes are drawn from a keyed space. Given names get an ending of the gender their titles tell,
or else a classifier over name endings, fitted on at most ``LABELLED`` titled names of the corpus itself. Surrogates
that two entities drew, or that are real entities of the corpus, are drawn again until all differ. Initials become the
surrogate's. Replacements stand in typed brackets, ``[NAME:...]``; everything else in the text is unchanged. The secret
is the caller's, or made of the corpus; there is none in the code.

Cases: null and empty texts hold nothing and come back as they are; repeated entities are listed once per document;
overlapping finds keep the stronger one; very long texts are read whole; rows that share an id, with one text or
several, each keep their own text.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import os
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.runtime import discard, table, written

TYPES = ("email", "address", "phone", "id_number", "name")
#: Most titled names the gender of given names is learned from.
LABELLED = 50_000

# ---------------------------------------------------------------- e-mail
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:@|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s@\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s?[\[({]\s?dot|\s(?:dot|DOT)\s)))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})+(?![\w@])", re.I)

# ---------------------------------------------------------------- phone
#: Shapes that are phone numbers unless their surroundings say otherwise.
_PHONE_STRONG = (
    r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}",
    r"\+\d{1,3}(?:[ .-]?\d{2,6}){1,4}",
    r"00\d{2}(?: ?\d{2,5}){2,4}",
    r"\(0\d{2,4}\) ?\d{3,4}[ -]?\d{3,4}",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}",
    r"0\d{3}-\d{3}-\d{4}",
    r"0\d{2} \d{4} \d{4}",
    r"0\d{4} \d{6}",
    r"\d{3}\.\d{3}\.\d{4}",
)
#: Shapes that need a cue before them, brackets around them or a line of their own.
_PHONE_WEAK = (r"\d{3}[ -]\d{3}[ -]\d{4}", r"\d{2}(?: \d{2}){4}", r"\d{5}[ -]\d{5}", r"0?\d{10}", r"0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}")
_NOT_IN = r"(?<![\w.,/+-])(?<!\d )(?<!- )"
PHONE = re.compile(rf"{_NOT_IN}(?:(?P<strong>{'|'.join(_PHONE_STRONG)})|(?P<weak>{'|'.join(_PHONE_WEAK)}))(?![\w/-]|\.\d| - )")
_PHONE_CUE = re.compile(r"(?:\b(?:phones?|fax|tel|telephone|mob|mobile|cell|call(?:ed)?|ring|whats ?app|contact|numbers?|reach\w*|dial|text|sms|helpline|left|ph|at|on|फोन|मोबाइल)\b[^.!?\n]{0,28}|[:.]\s?)$", re.I)
_PHONE_WORD = re.compile(r"\b(?:phones?|fax|tel|telephone|mob|mobile|cell|call|ring|whats ?app|contact|my number|number is|reach|dial|text|sms|helpline|parents left|left|ph|फोन|मोबाइल)\b[^!?\n]{0,30}$", re.I)
_QUANTITY = re.compile(r"^ ?,? ?(?:grains?|readings?|pieces?|copies|units|read across|lists?|%|kg|km|cm|ml|mol|and round)\b", re.I)
_CODE_BEFORE = re.compile(r"(?:\btable [\d.]+:?|\babout|\bsheet|\bpart \d+ is|\btake|\bcode|\bstring|\bfigure|\bpage)\s*$", re.I)

# ---------------------------------------------------------------- identity numbers
ID_SHAPE = re.compile(r"(?<![\w/-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{3,6}/\d{4}/\d{4,8}|[A-Z]{2}-\d{2}-\d{5,7}|[A-Z]\d{7})(?![\w/-])", re.I)
_ID_CUE = r"(?:roll(?:\s?/\s?id)?|enrol?lment|candidate|identity|tax\s+id|passport|aadhaa?r|\bpan\b|\bid\b|id\s+card|voter|licence|license|registration|\bcard\b|match|रोल|पहचान)"
ID_CUED = re.compile(rf"\b{_ID_CUE}[^.!?\n\d]{{0,24}}(?:no\.?|number|num|#)?\s*[:.#]?\s*(?P<v>(?:[A-Z]{{1,5}}[/-]?)?\d(?:[\dA-Z]|[ /-](?=[\dA-Z])){{5,20}})(?![\w-])", re.I)
_SPACED_ID = re.compile(r"^(?:\d{4}[ -]\d{4}[ -]\d{4}|\d{12}|[A-Z]{0,5}[/-]?\d[\dA-Z/-]{5,})", re.I)

# ---------------------------------------------------------------- addresses
#: Kinds of streets, as fixed values.
STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Crescent|Row|Drive|Place|Court|Terrace|Way|Square|Gali|Marg|Path|Nagar|Colony|Chowk|Bazaar|Vihar|Enclave|Cross|Main|Layout|Sector|Block|Boulevard|Walk|Hill|Gardens|Park|Mews|Gate|Salai|Rasta|Peth"
_UNIT = r"(?:(?:Flat|H\.?\s?No\.?|House(?:\s?No\.?)?|Plot(?:\s?No\.?)?|Door\s?No\.?|D\.?\s?No\.?|Apt\.?|Apartment|Unit|Qtr\.?|Quarter)\s*#?\s*[\w/-]{1,8},?\s+)"
_PLACE = r"[A-ZÀ-Ý][\w'À-ÿ-]*[a-zà-ÿ](?:\s[A-ZÀ-Ý][\w'À-ÿ-]*[a-zà-ÿ]){0,1}?"
_PIN = r"(?:,?\s*(?:-|–)?\s*(?:PIN(?:\s?code)?|Pin)?\s*[-:]?\s*\d{3}\s?\d{3}(?!\d))"
_CAP = r"[A-ZÀ-Ý0-9][\w'À-ÿ.-]*"
ADDRESS = re.compile(rf"(?<![\w/.-])(?:{_UNIT}\d{{1,4}}(?:/\d{{1,4}})?[A-Z]?,?\s+|{_UNIT}|\d{{1,4}}(?:/\d{{1,4}})?[A-Z]?,?\s+)(?:{_CAP}\s+){{1,3}}?(?:{STREETS})\b\.?(?:,\s*{_PLACE}{_PIN}?|{_PIN})?")
_UP_PLACE = r"[A-ZÀ-Ý][A-ZÀ-Ý'-]+"
ADDRESS_UP = re.compile(rf"(?<![\w/.-])(?:{_UNIT.upper().replace(chr(92) + 'S', chr(92) + 's').replace(chr(92) + 'W', chr(92) + 'w')})?\d{{1,4}}(?:/\d{{1,4}})?[A-Z]?,?\s+(?:[A-Z0-9']+\s+){{1,3}}?(?:{STREETS.upper()})\b(?:,\s*{_UP_PLACE}{_PIN}?|{_PIN})?")
ADDRESS_LOW = re.compile(rf"(?<![\w/.-])(?:(?:flat|h\.?\s?no\.?|house(?:\s?no\.?)?|plot(?:\s?no\.?)?)\s*#?\s*[\w/-]{{1,8}},?\s+)?\d{{1,4}}(?:/\d{{1,4}})?[a-z]?,?\s+(?:[a-z']+\s+){{1,3}}?(?:{STREETS.lower()})\b,\s*[a-zà-ÿ'-]+(?:,?\s*-?\s*(?:pin)?\s*\d{{3}}\s?\d{{3}}(?!\d))?")
_DEVA = "[\u0900-\u0963\u0970-\u097f]+"
ADDRESS_DEVA = re.compile(rf"(?<![\w\u0900-\u097f/-])(?:मकान|फ्लैट|प्लॉट|घर)\s*(?:नं\.?|नंबर|संख्या|क्र\.?)?\s*[\d/-]+,?\s+(?:{_DEVA}\s+){{0,3}}?(?:मार्ग|गली|नगर|रोड|सड़क|कॉलोनी|चौक|विहार|बाज़ार|बाजार)(?![\u0900-\u0963])(?:,\s*{_DEVA})?(?:,?\s*[-–]?\s*(?:पिन)?\s*\d{{3}}\s?\d{{3}}(?!\d))?")
_ADDRESS_CUE = re.compile(r"(?:\b(?:live|lives|stay|stays|reside\w*|addr|address|moved|deliver|post|send|room is|is at|house|home|at|from|to)\b[^.!?\n]{0,24}|\n|[:,]\s*|^)$", re.I)

# ---------------------------------------------------------------- names
_W = r"[A-ZÀ-Ý][a-zà-ÿ]+(?:[-'’][A-ZÀ-Ý]?[a-zà-ÿ]+)?"
_I = r"[A-ZÀ-Ý]\."
_NAME = rf"(?:{_I}\s(?:{_I}\s)?{_W}|{_W}\s(?:{_I}\s){{1,2}}{_W}|{_W}\s{_W}|{_W},\s{_W}(?:\s{_I})?)"
_WU = r"[A-ZÀ-Ý]{2,}(?:[-'’][A-ZÀ-Ý]+)?"
_NAME_UP = rf"(?:{_I}\s(?:{_I}\s)?{_WU}|{_WU}\s(?:{_I}\s){{1,2}}{_WU}|{_WU}\s{_WU}|{_WU},\s{_WU}(?:\s{_I})?)"
_wl = r"[a-zà-ÿ]{2,}(?:[-'’][a-zà-ÿ]+)?"
_NAME_LOW = rf"(?:[a-z]\.\s(?:[a-z]\.\s)?{_wl}|{_wl}\s(?:[a-z]\.\s){{1,2}}{_wl}|{_wl}\s{_wl}|{_wl},\s{_wl}(?:\s[a-z]\.)?)"
_ANY = rf"(?P<n>{_NAME}|{_NAME_UP}|{_NAME_LOW})"
_ANY_CASED = rf"(?P<n>{_NAME}|{_NAME_UP})"
_TITLE = r"(?:(?:[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Pp]rof|[Ss]hri|[Ss]mt|[Ss]ri|[Kk]um|MR|MRS|MS|DR|PROF)\.?\s|(?:Miss|Madam|Sir|Master|Kumari|Shrimati|Professor|Doctor)\s)?"
_BY = r"(?:asked|answered|posted|submitted|corrected|sent|signed|written|checked|reviewed|prepared|scanned|typed|solved|uploaded|drawn|edited|verified|compiled|entered|marked|copied|contributed|reported)"
#: What stands before a name.
NAME_CUES = [
    re.compile(rf"\b(?i:{_BY}\s+by)\s*:?\s+{_TITLE}{_ANY}(?![\w@])"),
    re.compile(rf"\b(?i:student|teacher|name|parent|guardian|author|tutor|candidate name|father|mother|invigilator|examiner|contact person|full name)\s?[:,]\s*{_TITLE}{_ANY}(?![\w@])"),
    re.compile(rf"\b(?i:my name is|my names|name is|i am called|this is|thank|thanks to|sat next to|next to|dear|ask for|meet|told|met with|spoke to|regards to|called)\s+{_TITLE}{_ANY_CASED}(?![\w@])"),
    re.compile(rf"\b(?i:my name is|please thank|i sat next to)\s+{_TITLE}{_ANY}(?![\w@])"),
    re.compile(rf"\b(?:[Ii] am|I'm|[Ii] AM)\s+{_TITLE}{_ANY}(?=,|\s(?:and|from|of)\b)"),
    re.compile(rf"(?:^|\n)[ \t]*(?i:yours (?:sincerely|faithfully|truly)|sincerely|(?:best |kind |warm )?regards|thanks(?: and regards)?|thank you|cheers|sent by|from|signed|respectfully)\s*[,:]?[ \t]*\n[ \t]*{_TITLE}{_ANY}(?=\s*(?:\n|$)|\s+(?:[A-Z+(0-9]|(?:tel|cc|mob|ph|fax|e-?mail)\b))"),
    re.compile(rf"(?<=[\s(“\"])(?i:yours (?:sincerely|faithfully|truly)|(?:best |kind |warm )?regards|thanks|sent by|from)\s*[,:][ \t]*\n[ \t]*{_TITLE}{_ANY}(?=\s*(?:\n|$)|\s+(?:[A-Z+(0-9]|(?:tel|cc|mob|ph|fax|e-?mail)\b))"),
    re.compile(rf"(?<!\w)(?:(?:[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Pp]rof|[Ss]hri|[Ss]mt|[Ss]ri|MR|MRS|MS|DR|PROF)\.\s|(?:Mr|Mrs|Ms|Dr|Prof|Shri|Smt|Miss)\s){_ANY}(?![\w@])"),
    re.compile(rf"\b(?i:as)\s+{_TITLE}{_ANY}\s+(?:pointed|said|noted|wrote|explained|mentioned|observed|showed|remarked)\b"),
    re.compile(rf"\b(?i:is|was|will|did|has)\s+{_TITLE}{_ANY}\s+(?:teaching|coming|taking|absent|present|marking|here|going)\b"),
]
#: Words that end a name in Devanagari.
_DEVA_END = "ने|को|से|का|के|की|जी|है|हैं|हूँ|था|थी|थे|में|पर|और|भी|तथा|द्वारा|कहते|कहती"
_NAME_DEVA = rf"(?P<n>(?:(?!(?:{_DEVA_END})(?![\u0900-\u0963])){_DEVA})(?:\s(?!(?:{_DEVA_END})(?![\u0900-\u0963])){_DEVA}){{0,2}})"
NAMES_DEVA = [
    re.compile(rf"(?<![\u0900-\u0963])(?:श्री|श्रीमती|सुश्री|कुमारी|डॉ\.?|प्रो\.)\s+(?:(?:श्री|श्रीमती|डॉ\.?)\s+)?{_NAME_DEVA}"),
    re.compile(rf"(?<![\u0900-\u0963])(?:मेरा\s+नाम\s*:?|(?:छात्र|छात्रा|शिक्षक|शिक्षिका|पिता|माता|परीक्षार्थी)(?:\s+का\s+नाम)?\s*:)\s*{_NAME_DEVA}"),
]
#: What stands after a name that opens a sentence.
_DOES = r"(?:says|said|scored|checked|signed|wrote|asked|replied|explained|solved|submitted|corrected|pointed|teaches|taught|told|noticed|answered|agrees|thinks|called|marked|lives|is absent|was absent|who)\b"
NAME_ACTS = re.compile(rf"(?:(?<=[.!?।\n)>\"”:0-9] )|(?<=\n)|^|(?<=\w )){_TITLE}(?P<n>{_NAME}|{_NAME_UP}|(?:(?<=\n)|(?<=[.!?।] )|^){_NAME_LOW})(?:,\s(?=signed|second reader|who)|\s)(?={_DOES}|signed|second reader)")
#: Words that belong to schools, firms, places and roles, or begin sentences; no part of a person's name.
NOT_NAMES = frozenset(
    "the a an and or of in at on for by to with as is was are be this that these those it its he she they we you i my your our their his her who what which when where why how if then please thank thanks regards dear sincerely yours call ring phone reach mail write send reply contact student teacher asked answered posted submitted corrected sent from school college university academy institute press edition reading room team warden head examiner chief key wing hall old new office desk board books house society trust club company firm ltd inc bank department council committee centre center library laboratory lab road street lane avenue close crescent row gali marg cross nagar colony each every after before during two take let show find hence note since here both given monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december spring summer autumn winter monsoon harvest question answer solution exercise page figure table chapter section part sheet paper code exam test class batch  principal director manager secretary controller superintendent invigilator whatsapp fax mobile tel mob ph addr address email e-mail id roll enrolment passport card tax candidate identity login my there all any some no not one three four five hi hello sir madam".split()
)
_PARTS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)?")


#: What makes the words before it the name of a school, firm or body.
_BODY = re.compile(r"[ \t]+(?:schools?|college|university|academy|institute|press|house|society|trust|club|company|ltd|inc|bank|books|publishers|library|hall|team|board|centre|center|committee|department|council|road|street|lane)\b", re.I)


def _person(text: str, a: int, b: int) -> bool:
    """Whether a find can be a person's name: no word of another kind in it, and no body named after it."""
    full = [w for w in _PARTS.findall(text[a:b]) if len(w) > 1]
    return bool(full) and not any(w.lower() in NOT_NAMES for w in full) and not _BODY.match(text, b)


# ---------------------------------------------------------------- where to look
#: Each pattern is run only around words it cannot do without; one automaton finds them all in one pass.
#: kind: (words, words of text looked at before and after them).
TRIGGERS: dict[str, tuple[tuple[str, ...], int, int]] = {
    "email": (("@", "dot", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at"), 5, 8),
    "address": (tuple(dict.fromkeys(STREETS.lower().split("|"))), 10, 10),
    "address_deva": (("मकान", "फ्लैट", "प्लॉट", "घर"), 1, 12),
    "id_cued": (("roll", "enrol", "candidate", "identity", "tax id", "tax  id", "passport", "aadha", "pan", "id", "voter", "licen", "registration", "card", "match", "रोल", "पहचान"), 1, 22),
    "cue0": (("by",), 2, 9),
    "cue1": (("student", "teacher", "name", "parent", "guardian", "author", "tutor", "father", "mother", "invigilator", "examiner", "contact person"), 2, 9),
    "cue2": (("my name", "my names", "name is", "i am called", "this is", "thank", "thanks to", "next to", "dear", "ask for", "meet", "told", "met", "met with", "spoke to", "regards to", "called"), 3, 10),
    "cue3": (("my name is", "please thank", "i sat next to"), 1, 8),
    "cue4": (("i am", "i'm"), 1, 9),
    "cue5": (("sincerely", "faithfully", "truly", "regards", "thanks", "thank you", "cheers", "sent by", "from", "signed", "respectfully"), 3, 12),
    "cue6": (("sincerely", "faithfully", "truly", "regards", "thanks", "sent by", "from"), 3, 12),
    "cue7": (("mr", "mrs", "ms", "dr", "prof", "shri", "smt", "sri", "miss"), 1, 8),
    "cue8": (("pointed", "said", "noted", "wrote", "explained", "mentioned", "observed", "showed", "remarked"), 9, 2),
    "cue9": (("teaching", "coming", "taking", "absent", "present", "marking", "here", "going"), 9, 2),
    "acts": (("says", "said", "scored", "checked", "signed", "wrote", "asked", "replied", "explained", "solved", "submitted", "corrected", "pointed", "teaches", "taught", "told", "noticed", "answered", "agrees", "thinks", "called", "marked", "lives", "is absent", "was absent", "who", "second reader"), 9, 3),
    "deva": (("श्री", "सुश्री", "कुमारी", "डॉ", "प्रो", "नाम", "छात्र", "शिक्षक", "शिक्षिका", "पिता", "माता", "परीक्षार्थी"), 3, 7),
}
#: Triggers inside longer words are none: before them for these kinds, before and after for those.
_LEFT = frozenset(k for k in TRIGGERS if k != "email" and "deva" not in k)
_RIGHT = _LEFT - {"id_cued"}


def _triggers() -> ahocorasick.Automaton:
    words: dict[str, list[str]] = {}
    for kind, (ws, _, _) in TRIGGERS.items():
        for w in ws:
            words.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, kinds in words.items():
        a.add_word(w, (len(w), [(k, k in _LEFT, k in _RIGHT, *TRIGGERS[k][1:]) for k in kinds]))
    a.make_automaton()
    return a


_TRIGGER = _triggers()
_ID_LIKE = re.compile(r"[A-Za-z]\d{4}|[A-Za-z]{3}/\d{4}/|[A-Za-z]{2}-\d{2}-\d")
_DIGIT_ROW = re.compile(r"[+(\d][\d().+ -]{6,}\d")
_SPACE = re.compile(r"\s+")


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Windows:
    """Stretches of whole words around places in a text."""

    def __init__(self, text: str) -> None:
        gaps = [m.span() for m in _SPACE.finditer(text)]
        self.size, self.starts, self.ends = len(text), [a for a, _ in gaps], [b for _, b in gaps]

    def before(self, at: int, words: int) -> int:
        k = bisect_left(self.starts, at) - words
        return self.ends[k] if k >= 0 else 0

    def after(self, at: int, words: int) -> int:
        k = bisect_left(self.starts, at) + words
        return self.starts[k] if k < len(self.starts) else self.size

    def merged(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def matches(self, rx: re.Pattern, text: str, lo: int, hi: int, more: int = 12) -> list[re.Match]:
        """The pattern's matches in a window, which grows while the last one stands near its end: what follows a match
        decides on it, and a pattern may go on as long as the text does."""
        while True:
            found = list(rx.finditer(text, lo, hi))
            if hi == self.size or not found or found[-1].end() <= self.before(hi, 3):
                return found
            hi, more = self.after(hi, more), 2 * more


class _Taken:
    """Spans claimed so far; the first claim keeps its characters."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def claim(self, a: int, b: int, kind: str) -> None:
        k = bisect_right(self.starts, a)
        if b > a and (k == 0 or self.spans[k - 1][1] <= a) and (k == len(self.starts) or self.starts[k] >= b):
            self.starts.insert(k, a)
            self.spans.insert(k, (a, b, kind))

    def begins_at(self, a: int) -> bool:
        k = bisect_left(self.starts, a)
        return k < len(self.starts) and self.starts[k] == a


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every item, in order, without overlaps."""
    around: dict[str, list[tuple[int, int]]] = defaultdict(list)
    low = _lower(text)
    size = len(low)
    win = _Windows(text)
    for end, (n, kinds) in _TRIGGER.iter(low):
        start = end + 1 - n
        joined_left = start > 0 and low[start - 1].isalnum()
        joined_right = end + 1 < size and low[end + 1].isalnum()
        for kind, left, right, before, after in kinds:
            if not ((joined_left and left) or (joined_right and right)):
                around[kind].append((win.before(start, before), win.after(end + 1, after)))
    around["id_shape"] = [(win.before(x.start(), 1), win.after(x.end(), 1)) for x in _ID_LIKE.finditer(text)]
    around["phone"] = [(max(0, x.start() - 2), win.after(x.end(), 2)) for x in _DIGIT_ROW.finditer(text)]
    taken = _Taken()

    def each(kind: str, *patterns: re.Pattern) -> Iterator[re.Match]:
        if spans := win.merged(around[kind]):
            for rx in patterns:
                for lo, hi in spans:
                    yield from win.matches(rx, text, lo, hi)

    for m in each("email", EMAIL):
        if "@" in m[0] or re.search(r"[\[({<]\s?at|\sat\s", m[0], re.I):
            taken.claim(*m.span(), "email")
    for m in each("address", ADDRESS, ADDRESS_UP, ADDRESS_LOW):
        if _ADDRESS_CUE.search(text[max(0, m.start() - 40) : m.start()]) or re.search(r"\d{3}\s?\d{3}$", m[0]) or "," in m[0]:
            taken.claim(*m.span(), "address")
    for m in each("address_deva", ADDRESS_DEVA):
        taken.claim(*m.span(), "address")
    for m in each("id_shape", ID_SHAPE):
        if m[0].upper() == m[0] or m[0].lower() == m[0]:
            taken.claim(*m.span(), "id_number")
    for m in each("id_cued", ID_CUED):
        v = _SPACED_ID.match(m["v"])
        if v and not _CODE_BEFORE.search(text[max(0, m.start("v") - 24) : m.start("v")]):
            taken.claim(m.start("v"), m.start("v") + v.end(), "id_number")
    for m in each("phone", PHONE):
        a, b = m.span()
        if not 9 <= sum(c.isdigit() for c in m[0]) <= 15 or _QUANTITY.match(text[b : b + 20]):
            continue
        before = text[max(0, a - 60) : a]
        if _CODE_BEFORE.search(before):
            continue
        if (more := re.match(r" ?\d", text[b : b + 2])) and not taken.begins_at(b + more.end() - 1):
            continue  # part of a longer row of digits
        if m["weak"]:
            own_line = (a == 0 or text[a - 1] == "\n") and text[b : b + 1] in ("\n", "")
            bracketed = text[a - 1 : a] == "(" and text[b : b + 1] == ")"
            if not (own_line or bracketed or _PHONE_WORD.search(before)):
                continue
        taken.claim(a, b, "phone")
    for n, rx in enumerate(NAME_CUES):
        for m in each(f"cue{n}", rx):
            if _person(text, *m.span("n")):
                taken.claim(*m.span("n"), "name")
    for m in each("acts", NAME_ACTS):
        if _person(text, *m.span("n")):
            taken.claim(*m.span("n"), "name")
    for m in each("deva", *NAMES_DEVA):
        taken.claim(*m.span("n"), "name")
    # a full name that is known stands for its person wherever it is
    full = {text[a:b] for a, b, kind in taken.spans if kind == "name" and sum(len(w) > 1 for w in _PARTS.findall(text[a:b])) > 1}
    for name in sorted(full):
        at = text.find(name)
        while at >= 0:
            if not (at and text[at - 1].isalnum()) and not text[at + len(name) : at + len(name) + 1].isalnum():
                taken.claim(at, at + len(name), "name")
            at = text.find(name, at + 1)
    return taken.spans


#: Titles that tell a person's gender.
_TITLED = re.compile(r"(?:\b(?:(?P<m>mr|shri|sri|master)|(?P<f>mrs|ms|miss|smt|kumari|kum|shrimati|madam))\.?|(?P<hm>श्री)|(?P<hf>श्रीमती|सुश्री|कुमारी))\s+$", re.I)


def title_gender(text: str, start: int) -> str | None:
    m = _TITLED.search(text[max(0, start - 12) : start])
    return None if m is None else "m" if m["m"] or m["hm"] else "f"


_DETECTED = "doc_id bigint, h bigint, n int, start int, stop int, pii_type string, pii_text string, entity string, gender string"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, h, text in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            spans = find(text)
            persons = entities_of_names([text[a:e] for a, e, kind in spans if kind == "name"])
            for n, (a, e, kind) in enumerate(spans):
                t = text[a:e]
                out.append((d, h, n, a, e, kind, t, persons[t] if kind == "name" else entity_of(kind, t), title_gender(text, a) if kind == "name" else None))
        cols = list(zip(*out)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *(pa.string(),) * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _DETECTED.split(", ")])


def detected(documents: DataFrame) -> DataFrame:
    """Every find: (doc_id, h, n, start, stop, pii_type, pii_text, entity, gender); h tells texts of one id apart."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return docs.mapInArrow(_detect, _DETECTED)


# ---------------------------------------------------------------- entities
def name_parts(name: str) -> list[str]:
    """Given names and surname of a name, in this order, case-folded; initials without their stop."""
    t = " ".join(name.casefold().split())
    if "," in t:
        last, _, first = t.partition(",")
        t = f"{first.strip()} {last.strip()}"
    return [w.rstrip(".") or w for w in t.split(" ") if w]


def _entity(parts: list[str]) -> str:
    """A person's parts without the initials among them, as long as a whole given name is left."""
    whole = [p for p in parts[:-1] if len(p) > 1]
    return " ".join([*(whole or parts[:-1]), *parts[-1:]])


def _fits(parts: list[str], person: list[str]) -> bool:
    """Whether a shorter form (initials and surname, or one part) can stand for a person."""
    if len(parts) == 1:
        return parts[0] in person
    return parts[-1] == person[-1] and all(any(q == p or (len(p) == 1 and q.startswith(p)) for q in person[:-1]) for p in parts[:1])


def entities_of_names(names: list[str]) -> dict[str, str]:
    """The entity of every name of one document."""
    parts = {n: name_parts(n) for n in names}
    full = {_entity(p) for p in parts.values() if len(p) > 1 and any(len(x) > 1 for x in p[:-1])}
    out = {}
    for n, p in parts.items():
        e = _entity(p)
        if e not in full and len(fit := [f for f in full if _fits(p, f.split(" "))]) == 1:
            e = fit[0]
        out[n] = e
    return out


def entity_of(kind: str, text: str) -> str:
    """What all mentions of one entity have in common."""
    t = " ".join(text.casefold().split())
    if kind == "name":
        return _entity(name_parts(text))
    if kind == "phone":
        return "".join(c for c in t if c.isdigit())[-9:]
    if kind == "email":
        t = re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s*@\s*", "@", t)
        return re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", ".", t)
    return re.sub(r"[\s,./-]+", "", t)


# ---------------------------------------------------------------- surrogates
def _draw(secret: bytes, *what: object) -> int:
    return int.from_bytes(hmac.new(secret, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest()[:8], "big")


#: Syllables of drawn names and streets, Latin and Devanagari.
_ON, _MID, _MALE, _FEMALE, _END = "b c d f g h j k l m n p r s t v z br dr tr pr st kl".split(), "a e i o u".split(), "n s l r m d".split(), "a i ya na la ra".split(), "man ker sen dal vic ton lund berg mar hart".split()
_DEVA_ON, _DEVA_ENDS = "क ग च ज त द न प ब म र ल व स ह".split(), {"m": "ान ेश ित ुल ार".split(), "f": "ा ी िका िता ावती".split()}


def _syllables(x: int, n: int) -> tuple[str, int]:
    out = ""
    for _ in range(n):
        x, a = divmod(x, len(_ON))
        x, b = divmod(x, len(_MID))
        out += _ON[a] + _MID[b]
    return out, x


def _word(x: int, like: str, given: bool, gender: str | None) -> str:
    """A drawn word in the script of the one it stands for; a given name ends as names of its gender do."""
    if any("ऀ" <= c <= "ॿ" for c in like):
        out = ""
        for _ in range(3):
            x, a = divmod(x, len(_DEVA_ON))
            out += _DEVA_ON[a]
        ends = _DEVA_ENDS[gender] if given and gender else _DEVA_ENDS["m"] + _DEVA_ENDS["f"]
        return out + ends[x % len(ends)]
    s, x = _syllables(x, 2)
    ends = {"m": _MALE, "f": _FEMALE}.get(gender or "", _MALE + _FEMALE) if given else _END
    return s + ends[x % len(ends)]


class Endings:
    """The gender of given names from their last letters: naive Bayes over endings of one to three letters."""

    def __init__(self, labelled: list[tuple[str, str]]) -> None:
        self.total = Counter(g for _, g in labelled)
        self.seen: Counter[tuple[str, str]] = Counter((w[-k:], g) for w, g in labelled for k in (1, 2, 3) if len(w) >= k)

    def of(self, name: str) -> str | None:
        """m or f; None where the names learned from do not tell."""
        if not self.total["m"] or not self.total["f"]:
            return None
        score = 0.0
        for k in (1, 2, 3):
            f, m = self.seen[name[-k:], "f"], self.seen[name[-k:], "m"]
            if len(name) >= k and f + m:
                score += math.log((f + 0.5) / (self.total["f"] + 1)) - math.log((m + 0.5) / (self.total["m"] + 1))
        return None if score == 0 else "f" if score > 0 else "m"


def _digits(secret: bytes, kind: str, digits: str, keep: int = 0) -> str:
    """A keyed permutation of the digit strings of one length (unbalanced Feistel): distinct stay distinct."""
    head, d = digits[:keep], digits[keep:]
    n = len(d)
    if n < 2:
        return head + "".join(str((int(c) + 1 + _draw(secret, kind, "d") % 9) % 10) for c in d)
    u = n // 2
    v = n - u
    a, b = int(d[:u]), int(d[u:])
    for r in range(8):
        m = u if r % 2 == 0 else v
        a, b = b, (a + _draw(secret, kind, n, r, b)) % 10**m
    return head + f"{a:0{u}d}{b:0{v}d}"


def surrogate(secret: bytes, kind: str, entity: str, turn: int, gender: str | None = None) -> str:
    """The replacement of an entity, in canonical form; turn counts the draws after collisions."""
    x = _draw(secret, kind, entity, turn)
    if kind in ("phone", "id_number"):
        letters = "".join(c for c in entity if not c.isdigit())
        d = _digits(secret, f"{kind}{letters}{turn or ''}", "".join(c for c in entity if c.isdigit()))
        it, k = iter(d), 0
        out = []
        for c in entity:
            if c.isdigit():
                out.append(next(it))
            else:
                k += 1
                out.append(chr(97 + (ord(c) - 97 + _draw(secret, kind, len(entity), k, turn) % 25 + 1) % 26) if "a" <= c <= "z" else c)
        return "".join(out)
    if kind == "email":
        s, r = _syllables(x, 4)
        return f"{s}{r % 1000:03d}@mail{_draw(secret, 'host', entity, turn) % 97}.example"
    if kind == "address":
        s, r = _syllables(x, 3)
        t, r2 = _syllables(_draw(secret, "town", entity, turn), 3)
        return f"{r % 400 + 1} {s.capitalize()} Street, {t.capitalize()} {r2 % 1000:03d}{r % 1000:03d}"
    words = entity.split(" ")
    return " ".join(_word(_draw(secret, "part", i, entity, turn), w, i < len(words) - 1, gender) for i, w in enumerate(words))


def _name_in_format(mention: str, value: str, entity: str) -> str:
    """A person's surrogate, part by part in the place of the parts of a mention; an initial becomes the surrogate's."""
    own, new = entity.split(" "), value.split(" ")
    turned = "," in mention
    pieces = re.findall(r"[^\s,]+", mention)
    surname = 0 if turned else len(pieces) - 1
    out = []
    for k, p in enumerate(pieces):
        plain = p.casefold().rstrip(".") or p
        if k == surname and (len(pieces) > 1 or plain == own[-1] or plain not in own):
            w = new[-1]
        elif len(plain) > 1:
            w = new[own.index(plain)] if plain in own[:-1] else new[0]
        else:
            like = next((i for i, q in enumerate(own[:-1]) if q.startswith(plain)), None)
            # a middle initial has no word of its own: a letter drawn from the surrogate
            w = (new[like][:1] if like is not None else chr(97 + sum(map(ord, value)) % 26)) + ("." if p.endswith(".") else "")
        out.append(w.upper() if p.isupper() else w if p.islower() else w[:1].upper() + w[1:])
    it = iter(out)
    return re.sub(r"[^\s,]+", lambda _: next(it), mention)


def in_format(kind: str, mention: str, value: str, entity: str | None = None) -> str:
    """The canonical surrogate written the way the mention was: case, order, separators; of a phone number what stands
    before its last nine digits is kept, since it tells country and kind."""
    if kind in ("phone", "id_number"):
        taken = (lambda c: c.isdigit()) if kind == "phone" else str.isalnum
        skip = max(0, sum(map(taken, mention)) - len(value)) if kind == "phone" else 0
        it = iter(value)
        out = []
        for c in mention:
            if taken(c) and skip:
                skip -= 1
                out.append(c)
            elif taken(c):
                v = next(it, c)
                out.append(v.upper() if c.isupper() else v)
            else:
                out.append(c)
        return "".join(out)
    if kind == "name":
        return _name_in_format(mention, value, entity or _entity(name_parts(mention)))
    if kind == "email":
        if "@" not in mention:
            at = re.search(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", mention, re.I)
            dot = re.search(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", mention, re.I)
            local, _, host = value.partition("@")
            value = local + (at[0] if at else "@") + (host.replace(".", dot[0]) if dot else host)
        return value.upper() if mention.isupper() else value
    return value.upper() if mention.isupper() else value.lower() if mention.islower() else value


def endings(found: DataFrame) -> Endings:
    """The gender classifier, from at most LABELLED titled names of the corpus."""
    given = F.get(F.split("entity", " "), F.lit(0))
    rows = found.where("pii_type = 'name' and gender is not null and entity like '% %'").select(given.alias("given"), "gender").where("length(given) > 1").distinct()
    return Endings([(r.given, r.gender) for r in rows.orderBy(F.xxhash64("given", "gender"), "given", "gender").limit(LABELLED).collect()])


def mapping(found: DataFrame, secret: str, most: int = 12) -> DataFrame:
    """(pii_type, entity, turn, surrogate) of every distinct entity of (pii_type, entity, gender). Entities that drew one
    surrogate draw again, all but the least of them, and so do those that drew a real entity, until every surrogate is
    of one entity only and none is real."""
    key = secret.encode()
    learned = endings(found)

    @F.udf(returnType="string", useArrow=True)
    def draw(kind, entity, turn, lean):
        gender = None if kind != "name" else "f" if lean > 0 else "m" if lean < 0 else learned.of(entity.split(" ")[0])
        return surrogate(key, kind, entity, turn, gender)

    lean = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0)).cast("int")
    open_ = found.groupBy("pii_type", "entity").agg(lean.alias("lean")).withColumn("turn", F.lit(0))
    settled = written(open_.withColumn("surrogate", draw("pii_type", "entity", "turn", "lean")), "p8-map")
    canonical = lambda c: F.when(F.col("pii_type") == "address", F.regexp_replace(F.lower(c), r"[\s,./-]+", "")).otherwise(F.col(c))
    for _ in range(most):
        real = settled.select("pii_type", F.col("entity").alias("said"))
        first = settled.groupBy("pii_type", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("keeper")).where("n > 1")
        twice = settled.join(first, ["pii_type", "surrogate"]).where("entity <> keeper").select("pii_type", "entity", "lean", "turn")
        known = settled.withColumn("said", canonical("surrogate")).join(real, ["pii_type", "said"], "left_semi").select("pii_type", "entity", "lean", "turn")
        clash = written(twice.unionByName(known).distinct(), "p8-clash")
        if clash.isEmpty():
            discard(clash)
            return settled
        again = clash.withColumn("turn", F.col("turn") + 1).withColumn("surrogate", draw("pii_type", "entity", "turn", "lean"))
        rest = settled.join(clash.select("pii_type", "entity"), ["pii_type", "entity"], "left_anti")
        last, settled = settled, written(rest.unionByName(again), "p8-map")
        discard(last, clash)
    raise RuntimeError("surrogates keep colliding; lengthen the drawn words")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text and spans:
                pieces, at = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    new = in_format(s["pii_type"], text[s["start"] : s["stop"]], s["surrogate"], s["entity"])
                    pieces += [text[at : s["start"]], f"[{s['pii_type'].upper()}:{new}]"]
                    at = s["stop"]
                text = "".join([*pieces, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def replaced(documents: DataFrame, secret: str) -> DataFrame:
    """(doc_id, text): every document with typed surrogates in place of personal information."""
    found = written(detected(documents), "p8-found")
    names = mapping(found, secret)
    spans = (
        found.join(names.select("pii_type", "entity", "surrogate"), ["pii_type", "entity"])
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("start", "stop", "pii_type", "surrogate", "entity")).alias("spans"))
    )
    docs = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return docs.join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_replace, "doc_id bigint, text string")


def secret_of(documents: DataFrame) -> str:
    """The secret of spark.quillmark.secret or QUILLMARK_SECRET. Without either one is made of the corpus: the
    digests of all its texts, summed in any order, digested again. Only who holds the very corpus can make it again, so
    that runs over the same data agree and replaced texts give nothing away."""
    own = documents.sparkSession.conf.get("spark.quillmark.secret", None) or os.environ.get("QUILLMARK_SECRET")
    if own:
        return own
    d = documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")).cast("string")
    total = d.agg(F.count("*").cast("string").alias("n"), *(part(i).alias(f"s{i}") for i in range(4))).first()
    return hashlib.sha256("|".join(map(str, total)).encode()).hexdigest()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p8_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(documents, secret_of(documents))
