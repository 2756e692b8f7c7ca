"""Scalar text functions as Columns. Python is used only where the JVM has no equivalent (a fixpoint, NFKC)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and lists whose matches decide results.
IMAGE_TOKEN = r"\[\[eq:([^\]]+)\]\]"
IMAGE_REF = r"!\[\]\(img:([^)\s]+)\)"
MD_IMAGE = r"!\[\]\([^)]*\)"
PYQ = r"(?i)\[?\(?\b(JEE(?:[ -]?(?:Main|Mains|Advanced|Adv))?|AIEEE|IIT[- ]?JEE|NEET|AIPMT|CBSE|NSEC|BITSAT)\b[^\]\)\n]{0,20}?\b((?:19|20)\d{2})\b"
OPTION_TYPES = ("single_correct", "multiple_correct", "multi_correct", "assertion_reason", "true_false")
OPTION_MARK = r"(?:^|\s)[\(\[]?([a-dA-D])[\)\].]\s+(?=\S)"
CORRECT = (
    r"(?i)(?:ans(?:wer)?|option|correct)\b(?:\W+(?:is|are|the|option|answer|choice|ans)\b)*\W{0,4}[\(\[]?([a-dA-D])[\)\].]?(?![a-zA-Z0-9])"
    r"|[\(\[]([a-dA-D])[\)\]]\s+(?:is\s+)?(?:the\s+)?correct"
)
BAD_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]"
MATHS = r"(?s)\\\(.+?\\\)|\\\[.+?\\\]|\$[^$]+\$"
SMALL_WORDS = ("and", "the", "of", "in", "to", "a", "an", "its", "our")
ROMAN = {"VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10", "XI": "11", "XII": "12"}
CLASS_NAME = r"(?i)class\s*[-–—:]?\s*(XII|XI|IX|X|VIII|VII|VI|\d{1,2})\b"
EXAMS = {"board": "BOARDS", "boards": "BOARDS", "jee": "JEE", "neet": "NEET"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def blank_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(""))


# ---- L1, L2, L19: maths delimiters
def to_paren_delims(x) -> Column:
    r"""``$$x$$`` to ``\[x\]``, then ``$x$`` to ``\(x\)``; an escaped or unpaired dollar stays."""
    c = F.regexp_replace(_c(x), r"(?s)(?<!\\)\$\$(.+?)(?<!\\)\$\$", r"\\[$1\\]")
    return F.regexp_replace(c, r"(?s)(?<!\\)\$(.+?)(?<!\\)\$", r"\\($1\\)")


def to_dollar_delims(x) -> Column:
    r"""The inverse: ``\[x\]`` to ``$$x$$``, ``\(x\)`` to ``$x$``."""
    c = F.regexp_replace(_c(x), r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(c, r"(?s)\\\((.+?)\\\)", r"\$$1\$")


def maths_spans(x) -> Column:
    """The contents of every maths span, in any of the three delimiter forms."""
    whole = F.regexp_extract_all(_c(x), F.lit(MATHS), F.lit(0))
    return F.transform(whole, lambda s: F.when(s.startswith("$"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(F.substring(s, F.lit(3), F.length(s) - 4)))


def has_bad_chars(x) -> Column:
    return _c(x).rlike(BAD_CHARS)


def balanced_delimiters(x) -> Column:
    r"""As many ``\(`` as ``\)`` and ``\[`` as ``\]``."""
    n = lambda p: F.size(F.regexp_extract_all(_c(x), F.lit(p), F.lit(0)))
    return (n(r"\\\(") == n(r"\\\)")) & (n(r"\\\[") == n(r"\\\]"))


def loose_scripts(x) -> Column:
    """A subscript or superscript mark outside every maths span and image reference."""
    return F.regexp_replace(_c(x), r"!\[\]\([^)]+\)|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]", " ").rlike(r"(?<!\\)[_^]")


# ---- L6, L7, L8: images in text
def image_names(x) -> Column:
    """Names in image tokens, in order of appearance."""
    return F.regexp_extract_all(_c(x), F.lit(IMAGE_TOKEN), F.lit(1))


def tokens_to_markdown(x, base: str = "images/") -> Column:
    return F.regexp_replace(_c(x), IMAGE_TOKEN, f"![]({base}$1)")


def resolve_refs(x, base: str) -> tuple[Column, Column]:
    """(text with real urls, image names in order) of an edited text."""
    c = F.coalesce(_c(x), F.lit(""))
    return strip(F.regexp_replace(c, IMAGE_REF, f"![]({base}$1)")), F.regexp_extract_all(c, F.lit(IMAGE_REF), F.lit(1))


def strip_images(x) -> Column:
    """Text without image references; blanks and empty lines squeezed."""
    c = F.regexp_replace(_c(x), r"[ \t]*!\[\]\([^)\s]*\)[ \t]*", " ")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fill_readings(text, readings) -> Column:
    """Image tokens with a trusted reading replaced by maths; an empty reading removes the token.

    readings: map<name, struct<latex, needs_review, ...>>. A null map leaves the text."""
    entries = F.filter(F.map_entries(_c(readings)), lambda e: e["value"]["latex"].isNotNull() & ~F.coalesce(e["value"]["needs_review"], F.lit(False)))
    filled = F.aggregate(
        entries,
        _c(text),
        lambda acc, e: F.replace(acc, F.concat(F.lit("[[eq:"), e["key"], F.lit("]]")), F.when(e["value"]["latex"] == "", F.lit("")).otherwise(F.concat(F.lit("\\("), e["value"]["latex"], F.lit("\\)")))),
    )
    return F.regexp_replace(F.coalesce(filled, _c(text)), r"[ \t]{2,}", " ")


# ---- L3: every string of nested columns
def converted(value: Column, kind: T.DataType, convert) -> Column:
    """A nested value with ``convert`` applied to every string in it, map keys left alone."""
    if isinstance(kind, T.StringType):
        return convert(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: converted(v, kind.elementType, convert))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: converted(v, kind.valueType, convert))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(converted(value[f.name], f.dataType, convert).alias(f.name) for f in kind.fields)))
    return value


def changes(value: Column, kind: T.DataType, convert) -> Column:
    """How many strings of a nested value ``convert`` changes; nulls are no strings."""
    total = lambda a, t: F.aggregate(F.coalesce(a, F.array().cast(T.ArrayType(t))), F.lit(0), lambda n, v: n + changes(v, t, convert))
    if isinstance(kind, T.StringType):
        return F.coalesce((convert(value) != value).cast("int"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return total(value, kind.elementType)
    if isinstance(kind, T.MapType):
        return total(F.map_values(value), kind.valueType)
    if isinstance(kind, T.StructType):
        return sum((changes(value[f.name], f.dataType, convert) for f in kind.fields), F.lit(0))
    return F.lit(0)


def merged_maps(a, b) -> Column:
    """Both maps as one; where both have a key the second wins. A null map counts as empty."""
    x, y = (F.coalesce(_c(m), F.create_map().cast("map<string,string>")) for m in (a, b))
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


# ---- L9: options
def split_options(text, qtype) -> tuple[Column, Column]:
    """(stem, options) of a choice question whose choices stand in its text.

    Only for the choice types, with two marks or more, the first of them A, none twice and none empty; otherwise the
    text stays and there are no options. The order of further labels is not checked."""
    t = _c(text)
    labels = F.transform(F.regexp_extract_all(t, F.lit(OPTION_MARK), F.lit(1)), F.upper)
    pieces = F.split(t, OPTION_MARK, -1)
    bodies = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), strip)
    ok = (
        _c(qtype).isin(*OPTION_TYPES)
        & (F.size(labels) >= 2)
        & (F.get(labels, F.lit(0)) == "A")
        & (F.size(F.array_distinct(labels)) == F.size(labels))
        & F.forall(bodies, lambda b: b != "")
    )
    made = F.transform(F.arrays_zip(labels.alias("label"), bodies.alias("body")), lambda o: F.struct(o["label"].alias("label"), o["body"].alias("body"), F.lit(False).alias("isCorrect")))
    none = F.array().cast("array<struct<label:string,body:string,isCorrect:boolean>>")
    yes = F.coalesce(ok, F.lit(False))
    return F.when(yes, strip(F.get(pieces, F.lit(0)))).otherwise(t), F.when(yes, made).otherwise(none)


def named_option(x) -> Column:
    """The option label a text calls correct, or null."""
    one, two = (F.regexp_extract(F.coalesce(_c(x), F.lit("")), CORRECT, g) for g in (1, 2))
    return blank_to_null(F.upper(F.when(one != "", one).otherwise(two)))


def mark_correct(options, *texts) -> Column:
    """Options with the one ticked that the first text naming a present label names."""
    o = _c(options)
    present = F.transform(o, lambda x: x["label"])
    named = F.transform(F.array(*map(named_option, texts)), lambda n: F.when(F.array_contains(present, n), n))
    want = F.get(F.array_compact(named), F.lit(0))
    return F.transform(o, lambda x: F.struct(x["label"].alias("label"), x["body"].alias("body"), F.coalesce(x["label"] == want, F.lit(False)).alias("isCorrect")))


# ---- L10-L16, L31
def pyq_exam(x) -> Column:
    return blank_to_null(F.replace(F.upper(F.regexp_extract(_c(x), PYQ, 1)), F.lit(" "), F.lit("-")))


def pyq_year(x) -> Column:
    return F.regexp_extract(_c(x), PYQ, 2).try_cast("int")


def normalize_exam(x) -> Column:
    c = strip(x)
    known = F.create_map(*(F.lit(v) for kv in EXAMS.items() for v in kv))
    return F.coalesce(F.try_element_at(known, F.lower(c)), blank_to_null(c))


def to_int(x) -> Column:
    return _c(x).try_cast("int")


def title_words(x) -> Column:
    """Lower-cased letter-digit words without the small ones, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*SMALL_WORDS))


def title_score(a, b) -> Column:
    """Jaccard of two titles' word sets."""
    x, y = F.array_distinct(title_words(a)), F.array_distinct(title_words(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def plain_words(x) -> Column:
    """Text stripped of images, maths and figure marks, as lower-case words joined by spaces."""
    c = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?s)!\[\]\([^)]*\)|\\\(.*?\\\)|\\\[.*?\\\]|\$[^$]*\$|\[\[FIGURE\]\]", " ")
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")


def prose_words(x) -> Column:
    """Words of three letters and more outside maths, images and commands."""
    c = F.regexp_replace(F.coalesce(_c(x), F.lit("")), MATHS, " ")
    c = F.regexp_replace(c, r"!\[\]\([^)]+\)", " ")
    c = F.regexp_replace(c, r"\\[A-Za-z]+\*?", " ")
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{3,}"), F.lit(0))


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b)])


def shared_count(a, b) -> Column:
    """How many words two arrays of a row share, with repeats: the smaller of both counts, summed."""
    return _shared(_c(a), _c(b))


# ---- L17, L18
def file_stem(x) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), r"^.*[/\\]", ""), r"\.[^.]*$", "")


def chapter_of_file(x) -> Column:
    """``Chapter 15 - Probability.pdf`` to ``Probability``."""
    return strip(F.regexp_replace(file_stem(x), r"(?i)^Chapter\s*\d+\s*-\s*", ""))


def bundle_name(x, fallback) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(chapter_of_file(x), F.lit("")), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(blank_to_null(slug), _c(fallback))


def safe_name(x) -> Column:
    return strip(F.regexp_replace(_c(x), r'[<>:"/\\|?*]+', ""))


def slug_title(x) -> Column:
    return F.initcap(F.regexp_replace(F.trim(F.replace(_c(x), F.lit("-"), F.lit(" "))), r"(?i)^chapter \d+\s*", ""))


def class_name(x) -> Column:
    """``(Class - IX)`` to ``Class 9``; null where no class is named."""
    n = F.upper(F.regexp_extract(_c(x), CLASS_NAME, 1))
    known = F.create_map(*(F.lit(v) for kv in ROMAN.items() for v in kv))
    return F.when(n != "", F.concat(F.lit("Class "), F.coalesce(F.try_element_at(known, n), n)))


# ---- L20: model replies
def clean_reply(x) -> Column:
    """A reply without code fences and one pair of maths delimiters around it."""
    c = strip(F.regexp_replace(strip(F.coalesce(_c(x), F.lit(""))), r"^```(?:latex|tex)?\s*|\s*```$", ""))
    cut = lambda k: F.substring(c, F.lit(k + 1), F.greatest(F.length(c) - 2 * k, F.lit(0)))
    return strip(
        F.when(c.startswith("$$") & c.endswith("$$"), cut(2))
        .when(c.startswith("$") & c.endswith("$"), cut(1))
        .when(c.startswith("\\(") & c.endswith("\\)"), cut(2))
        .otherwise(c)
    )


def parse_reply(x) -> Column:
    """struct<kind, latex> of a model's reply: JSON where it is JSON, bare LaTeX otherwise."""
    s = strip(F.regexp_replace(strip(F.coalesce(_c(x), F.lit(""))), r"^```(?:json)?\s*|\s*```$", ""))
    js = F.from_json(s, "kind string, latex string", {"mode": "PERMISSIVE"})
    is_json = s.startswith("{") & s.endswith("}") & (js["kind"].isNotNull() | js["latex"].isNotNull() | F.get_json_object(s, "$").isNotNull())
    latex = F.when(is_json, blank_to_null(clean_reply(js["latex"]))).otherwise(blank_to_null(clean_reply(s)))
    said = F.when(is_json, F.lower(F.coalesce(js["kind"], F.lit("")))).otherwise(F.lit("formula"))
    kind = F.when(said.isin("formula", "figure", "blank"), said).when(latex.isNotNull(), "formula").otherwise("blank")
    return F.struct(kind.alias("kind"), F.when(kind == "formula", latex).alias("latex"))


# ---- L21, L24-L27
def id_stamp(x) -> Column:
    """Creation time in milliseconds from the first eight hex digits of an id; 0 where they are not hex."""
    head = F.substring(_c(x), 1, 8)
    return F.when(head.rlike("^[0-9a-fA-F]{8}$"), F.conv(head, 16, 10).cast("bigint") * 1000).otherwise(F.lit(0).cast("bigint"))


def stable_id(*parts) -> Column:
    """24 hex digits from the natural key: the same row gets the same id in every run."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 24)


def masked(x) -> Column:
    """A connection string or key that can be shown: scheme and host, or the ends of a long value."""
    c = _c(x)
    uri = F.concat(F.regexp_extract(c, r"^([A-Za-z0-9+.-]+://)", 1), F.lit("***@"), F.substring_index(c, "@", -1))
    return F.when(c.rlike("^[A-Za-z0-9+.-]+://.*@"), uri).when(F.length(c) > 12, F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(4)))).otherwise(F.lit("***"))


def public_url(base, bucket, dest) -> Column:
    return F.concat(F.regexp_replace(_c(base), "/+$", ""), F.lit("/storage/v1/object/public/"), _c(bucket), F.lit("/"), _c(dest))


def iso_ms(x) -> Column:
    """A timestamp as ISO-8601 with milliseconds and Z."""
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(x) -> Column:
    return F.to_timestamp(F.regexp_replace(_c(x), "Z$", "+00:00"))


# ---- L4, L5: what needs Python
def per_distinct(values: pd.Series, f) -> pd.Series:
    """f once for each distinct value; null stays null."""
    done = {v: f(v) for v in values.dropna().unique()}
    return pd.Series([done.get(v) for v in values], dtype=object)


def _latex_rules():
    import re

    # Rewrites in this order, font commands first and until none is left.
    font = re.compile(r"(\\[A-Za-z]+)?\\(?:mathrm|mathbf|mathit|boldsymbol|textbf|textrm)\s*\{([A-Za-z0-9 ]{1,12})\}")
    tilde = re.compile(r"\\mathrm\{([^{}]*~[^{}]*)\}")
    rules = [
        (re.compile(r"\\(?:textstyle|displaystyle)\s*"), ""),
        (re.compile(r"\^\{\s*(?:\*|\\ast|\\bullet)+\s*\}"), "*"),
        (re.compile(r"^\s*\\cdot\s*\\cdot\s*"), r"\\therefore "),
        (re.compile(r"\{\\cal\s+([A-Za-z])\}"), r"{\1}"),
        (re.compile(r"\\big[lr]?\s*([()\[\]])"), r"\1"),
        (re.compile(r"\\operatorname\{([a-z]+)\}"), r"\\text{ \1 }"),
        (tilde, None),
        (re.compile(r"\\[,;!]\s*(\\right)"), r"\1"),
        (re.compile(r"\\(in|notin|to|neq|leq|geq|times|subset|cup|cap)(?=[A-Z])"), r"\\\1 "),
        (re.compile(r"\\(?:,|;|!|quad|qquad)\s*$"), ""),
        (re.compile(r"\s+"), " "),
    ]
    return font, rules


_LATEX_RULES = _latex_rules()


def clean_latex_text(s: str | None) -> str | None:
    """Recogniser output without needless font commands and other habits of the recogniser."""
    if s is None:
        return None
    font, rules = _LATEX_RULES
    while (t := font.sub(lambda m: (f"{m[1]} " if m[1] else "") + m[2].replace(" ", ""), s)) != s:
        s = t
    for rx, to in rules:
        s = rx.sub(to, s) if to is not None else rx.sub(lambda m: "\\text{" + m[1].replace("~", " ") + "}", s)
    return s.strip()


@F.pandas_udf(T.StringType())
def clean_latex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield per_distinct(s, clean_latex_text)


def ocr_fix_text(s: str | None) -> str | None:
    import re
    import unicodedata

    if s is None:
        return None
    t = unicodedata.normalize("NFKC", s).strip()
    t = re.sub(r"^Q\s*\.\s*[lI|](?=[.\s:)])", "Q.1", t)
    return re.sub(r"^(Q\s*\.\s*\d*)[lI|](?=[.\s:)])", r"\g<1>1", t)


@F.pandas_udf(T.StringType())
def ocr_fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield per_distinct(s, ocr_fix_text)
