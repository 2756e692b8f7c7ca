"""Queries over free texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import review, sets
from quillmark.operators import rollups as R
from quillmark.runtime import table


def _docs(s, d):
    return table(s, d, "documents")


def exact_duplicates(s, d):
    return R.same_content(_docs(s, d), "doc_id", "text")


def kept_firsts(s, d):
    return R.keep_first(_docs(s, d).select("doc_id", "source", "n_chars", "text"), [F.md5("text")], ["doc_id"]).select("doc_id", "source", "n_chars")


def repeated_lines(s, d):
    return R.repeated_lines(_docs(s, d))


def maths_spans(s, d):
    return _docs(s, d).select("doc_id", X.maths_spans("text").alias("m")).select("doc_id", F.size("m").alias("spans"), F.md5(F.array_join("m", "\n")).alias("digest"))


def dollar_delims(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.to_dollar_delims("text")).alias("digest"))


def paren_delims(s, d):
    """Texts in dollar form turned back."""
    return _docs(s, d).select("doc_id", F.md5(X.to_paren_delims(X.to_dollar_delims("text"))).alias("digest"))


def control_characters(s, d):
    return _docs(s, d).where(X.has_bad_chars("text")).select("doc_id")


def unbalanced_maths(s, d):
    return _docs(s, d).where(~X.balanced_delimiters("text")).select("doc_id")


def loose_scripts(s, d):
    return _docs(s, d).where(X.loose_scripts("text")).select("doc_id")


def plain_words(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.plain_words("text")).alias("digest"))


def title_word_counts(s, d):
    return _docs(s, d).select("doc_id", F.size(X.title_words("text")).alias("words"), F.size(F.array_distinct(X.title_words("text"))).alias("distinct_words"))


def named_options(s, d):
    return _docs(s, d).select("doc_id", X.named_option("text").alias("label")).where("label is not null")


def model_replies(s, d):
    """Replies of a model made of the documents: JSON, fenced JSON, bare LaTeX."""
    t = F.regexp_replace("text", r'["\\\n]', " ")
    js = F.concat(F.lit('{"kind": "'), F.element_at(F.array(*map(F.lit, ("formula", "Figure", "blank", "other"))), F.pmod("doc_id", F.lit(4)).cast("int") + 1), F.lit('", "latex": "'), t, F.lit('"}'))
    reply = F.when(F.pmod("doc_id", F.lit(3)) == 0, js).when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(F.concat(F.lit("$"), t, F.lit("$")))
    return _docs(s, d).select("doc_id", X.parse_reply(reply).alias("r")).select("doc_id", "r.kind", "r.latex")


def cache_misses(s, d):
    w = _docs(s, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"), "kind")
    bad = F.col("kind") == "exam_report"
    cache = w.where("kind <> 'doubt_thread'").select(F.concat(F.lit("v2:m:"), "md5").alias("key"), F.lit("formula").alias("kind"), F.when(~bad, "x").alias("latex"), F.when(bad, "timeout").alias("error"))
    return sets.cache_lookup(w.drop("kind"), cache, "2", "m")[1]


def cache_hits(s, d):
    w = _docs(s, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"), "kind")
    cache = w.where("kind <> 'doubt_thread'").select(F.concat(F.lit("v2:m:"), "md5").alias("key"), F.lit("formula").alias("kind"), F.lit("x").alias("latex"), F.lit(None).cast("string").alias("error"))
    return sets.cache_lookup(w.drop("kind"), cache, "2", "m")[0].select("id", "md5")


def source_signatures(s, d):
    return R.signature(_docs(s, d).where("source is not null"), "source", ["doc_id", "text"])


def source_batches(s, d):
    return R.numbered_batches(_docs(s, d).select("doc_id", F.coalesce("source", F.lit("none")).alias("source")), "source", ["doc_id"], 12, F.floor(F.col("doc_id") / 100_000)).select("doc_id", "batch")


def source_usage(s, d):
    return R.usage(_docs(s, d).withColumn("w", F.size(F.split("text", " "))), ["kind", "lang"], "n_chars", "w")


def guarded_writes(s, d):
    cur = _docs(s, d).select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("none")).alias("text"), "kind")
    new = cur.where("kind <> 'review_log'").select("key", F.when(F.col("kind") == "doubt_thread", "stale").otherwise(F.col("text")).alias("expected"), F.lit("moved").alias("new_text"))
    return review.write_if_unchanged(cur.drop("kind"), new)


def roots_union(s, d):
    a = _docs(s, d).where("source is not null").select("doc_id", "source", F.lit("new").alias("root"))
    b = _docs(s, d).select("doc_id", "source", F.lit("old").alias("root"))
    return sets.first_root_wins([a, b], "doc_id")


def fixed_ocr(s, d):
    t = F.concat(F.lit(" Q.l. "), "text")
    return _docs(s, d).select("doc_id", X.ocr_fix(t).alias("text"))


def cleaned_latex(s, d):
    t = F.concat(F.lit(r"\mathrm{ab}\in\mathbf{R} \textstyle x^{\ast}"), F.col("text"), F.lit(r" \quad"))
    return _docs(s, d).select("doc_id", X.clean_latex(t).alias("latex"))


QUERIES = {f.__name__: f for f in (exact_duplicates, kept_firsts, repeated_lines, maths_spans, dollar_delims, paren_delims, control_characters, unbalanced_maths, loose_scripts, plain_words, title_word_counts, named_options, model_replies, cache_misses, cache_hits, source_signatures, source_batches, source_usage, guarded_writes, roots_union, fixed_ocr, cleaned_latex)}

_DOLLAR = r"regexp_replace(regexp_replace(text, '\\\[(.+?)\\\]', '$$\1$$', 'gs'), '\\\((.+?)\\\)', '$\1$', 'gs')"
_SMALL = "('and','the','of','in','to','a','an','its','our')"
SQL = {
    "exact_duplicates": "select md5(lower(text)) as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1",
    "kept_firsts": "select doc_id, source, n_chars from (select *, row_number() over (partition by text order by doc_id) as r from documents) where r = 1",
    "repeated_lines": "with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents) select line, count(*)::bigint as n, count(distinct doc_id) as docs from l where line <> '' group by line having count(*) >= 2",
    "maths_spans": r"with m as (select doc_id, list_transform(regexp_extract_all(text, '(?s)\\\(.+?\\\)|\\\[.+?\\\]|\$[^$]+\$', 0), lambda s: case when s[1] = '$' then s[2:-2] else s[3:-3] end) as m from documents) select doc_id, len(m)::int as spans, md5(coalesce(array_to_string(m, chr(10)), '')) as digest from m",
    "dollar_delims": f"select doc_id, md5({_DOLLAR}) as digest from documents",
    # an escaped dollar is hidden while the others are paired
    "paren_delims": rf"select doc_id, md5(replace(regexp_replace(regexp_replace(replace({_DOLLAR}, '\$', chr(1)), '\$\$(.+?)\$\$', '\\[\1\\]', 'gs'), '\$(.+?)\$', '\\(\1\\)', 'gs'), chr(1), '\$')) as digest from documents",
    "control_characters": r"select doc_id from documents where regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffd}]')",
    "unbalanced_maths": r"select doc_id from documents where len(regexp_extract_all(text, '\\\(')) <> len(regexp_extract_all(text, '\\\)')) or len(regexp_extract_all(text, '\\\[')) <> len(regexp_extract_all(text, '\\\]'))",
    "loose_scripts": r"select doc_id from documents where regexp_matches(replace(replace(regexp_replace(text, '(?s)!\[\]\([^)]+\)|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g'), '\_', ''), '\^', ''), '[_^]')",
    "plain_words": r"select doc_id, md5(coalesce(array_to_string(regexp_extract_all(lower(regexp_replace(text, '(?s)!\[\]\([^)]*\)|\\\(.*?\\\)|\\\[.*?\\\]|\$[^$]*\$|\[\[FIGURE\]\]', ' ', 'g')), '[a-z0-9]+', 0), ' '), '')) as digest from documents",
    "title_word_counts": f"with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+', 0), lambda w: w not in {_SMALL}) as w from documents) select doc_id, len(w)::int as words, len(list_distinct(w))::int as distinct_words from w",
    "model_replies": r"""with t as (select doc_id, regexp_replace(text, '["\\\n]', ' ', 'g') as t, ['formula', 'figure', 'blank', 'other'][(doc_id % 4 + 1)::int] as said from documents),
  c as (select *, nullif(regexp_replace(t, '^\s+|\s+$', '', 'g'), '') as latex, case when doc_id % 3 = 2 then 'formula' else said end as k from t), e as (select *, case when k in ('formula', 'figure', 'blank') then k when latex is not null then 'formula' else 'blank' end as kind from c)
  select doc_id, kind, case when kind = 'formula' then latex end as latex from e""",
    "cache_misses": "with w as (select doc_id, md5(text) as md5, kind from documents), good as (select distinct md5 from w where kind not in ('doubt_thread', 'exam_report')) select distinct md5 from w anti join good using (md5)",
    "cache_hits": "with w as (select doc_id, md5(text) as md5, kind from documents), good as (select distinct md5 from w where kind <> 'doubt_thread') select doc_id as id, md5 from w semi join good using (md5)",
    "source_signatures": "with h as (select source, sha256(doc_id || chr(31) || text) as h from documents where source is not null), b as (select source, substr(h, 1, 3) as k, sha256(string_agg(h, chr(10) order by h)) as d, count(*) as n from h group by 1, 2) select source, sha256(string_agg(k || d, chr(10) order by k)) as signature, sum(n)::bigint as records from b group by 1",
    "source_batches": "select doc_id, ((row_number() over (partition by coalesce(source, 'none') order by doc_id) - 1) // 12)::int as batch from documents",
    "source_usage": "select kind, lang, count(*) as calls, sum(n_chars)::bigint as input, sum(len(string_split(text, ' ')))::bigint as output from documents group by all",
    "guarded_writes": "select doc_id as key, case when kind not in ('review_log', 'doubt_thread') then 'moved' else coalesce(source, 'none') end as text, kind not in ('review_log', 'doubt_thread') as written from documents",
    "roots_union": "select doc_id, source, case when source is not null then 'new' else 'old' end as root from documents",
    "named_options": r"""with l as (select doc_id, regexp_extract(text, '(?i)(?:ans(?:wer)?|option|correct)\b(?:\W+(?:is|are|the|option|answer|choice|ans)\b)*\W{0,4}[\(\[]?([a-dA-D])[\)\].]?(?:[^a-zA-Z0-9]|$)|[\(\[]([a-dA-D])[\)\]]\s+(?:is\s+)?(?:the\s+)?correct', 1) as a, regexp_extract(text, '(?i)(?:ans(?:wer)?|option|correct)\b(?:\W+(?:is|are|the|option|answer|choice|ans)\b)*\W{0,4}[\(\[]?([a-dA-D])[\)\].]?(?:[^a-zA-Z0-9]|$)|[\(\[]([a-dA-D])[\)\]]\s+(?:is\s+)?(?:the\s+)?correct', 2) as b from documents)
  select doc_id, upper(coalesce(nullif(a, ''), nullif(b, ''))) as label from l where coalesce(nullif(a, ''), nullif(b, '')) is not null""",
}
