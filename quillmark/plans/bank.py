"""Queries over question records, ingested documents and the syllabus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions import text as X
from quillmark.operators import export, review, sets, syllabus
from quillmark.operators import rollups as R
from quillmark.runtime import table
from quillmark.sources import sinks

FIELDS = ["id", "documentId", "questionNumber", "questionType", "level", "topic", "subject", "className", "flagged", "updatedAt"]


def _latest(s, d, *more):
    q = table(s, d, "question").where("id is not null").select(*dict.fromkeys([*FIELDS, *more]))
    q = q.withColumn("__l", F.coalesce("level", F.lit(""))).withColumn("__f", F.coalesce("flagged", F.lit(False)))
    return review.latest(q, ["id"], ["updatedAt", "__l", "__f"]).drop("__l", "__f")


def latest_records(s, d):
    return _latest(s, d).select("id", "documentId", "questionType", "level", "flagged", "updatedAt")


def document_parents(s, d):
    return R.parents(table(s, d, "question"))


def missing_fields(s, d):
    q = _latest(s, d, "path").select("id", F.array_join(review.missing_fields(), ",").alias("missing"))
    return q.where("missing <> ''")


def export_gate(s, d):
    return R.gate(_latest(s, d, "path"))


def exam_names(s, d):
    return table(s, d, "question").select("exam", X.normalize_exam("exam").alias("normal")).distinct()


def inline_options(s, d):
    """Choices written into the stem and taken out again."""
    q = table(s, d, "question").select("id", "stem", "questionType", "options").distinct()
    marks = F.transform("options", lambda o: F.concat(F.lit("("), F.lower(o["label"]), F.lit(") "), F.coalesce(o["body"], F.lit(""))))
    q = q.withColumn("t", F.concat(F.coalesce("stem", F.lit("")), F.lit("\n"), F.array_join(marks, "  ")))
    stem, options = X.split_options("t", "questionType")
    q = q.withColumn("o", options)
    return q.select("id", F.size("o").alias("n"), F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["label"], x["body"])), "|").alias("options"), F.md5(stem).alias("stem_md5")).distinct()


def marked_options(s, d):
    q = table(s, d, "question").select("id", "options", "answer").where("size(options) > 0").distinct()
    o = X.mark_correct("options", F.concat(F.lit("Ans. ("), F.lower("answer"), F.lit(")")))
    return q.select("id", F.array_join(F.transform(F.filter(o, lambda x: x["isCorrect"]), lambda x: x["label"]), ",").alias("ticked")).distinct()


def previous_years(s, d):
    t = F.concat(F.lit("["), F.coalesce("exam", F.lit("")), F.lit(" Main, "), F.coalesce("pyqYear", F.lit(0)).cast("string"), F.lit("]"))
    q = table(s, d, "question").select("id", t.alias("t")).distinct()
    return q.select("id", X.pyq_exam("t").alias("exam"), X.pyq_year("t").alias("year"))


def id_stamps(s, d):
    return table(s, d, "question").where("id is not null").select("id", X.id_stamp("id").alias("stamp")).distinct()


def title_guess(s, d):
    t = table(s, d, "ingest_document").select("documentId", "fileName", "subject", "className").distinct()
    name = F.trim(F.regexp_replace(F.regexp_replace(X.file_stem("fileName"), "_", " "), r"(?i)^class \d+ (maths|physics|chemistry|biology) | \(\d+\)$", ""))
    t = t.select(F.concat_ws("|", "documentId", "fileName").alias("id"), name.alias("title"), "subject", F.col("className").alias("class_hint"))
    return syllabus.guess(t, table(s, d, "syllabus"))


def exact_chapter(s, d):
    t = table(s, d, "ingest_document").select(F.col("documentId").alias("id"), "className", "subject", "chapter").where("className is not null and subject is not null and chapter is not null").distinct()
    return syllabus.exact_key(t, table(s, d, "syllabus"))


def fuzzy_chapter(s, d):
    """Chapter names without their first letter, as decorated titles are read."""
    t = table(s, d, "ingest_document").where("chapter is not null").select(F.col("chapter").alias("id"), F.substring("chapter", F.lit(2), F.length("chapter")).alias("title")).distinct()
    c = table(s, d, "syllabus").groupBy(F.col("chapter").alias("candidate")).agg(F.min(F.concat("className", "subject")).alias("o")).select("candidate", F.conv(F.substring(F.md5("candidate"), 1, 7), 16, 10).cast("bigint").alias("ord"))
    return syllabus.fuzzy_match(t, c)


def syllabus_chapters(s, d):
    return syllabus.chapters(table(s, d, "syllabus")).select("key", F.array_join("topics", "; ").alias("topics"))


def allowed_topics(s, d):
    q = _latest(s, d, "path").select("id", F.array().cast("array<string>").alias("own"), F.when(F.col("flagged"), F.concat_ws("/", "className", "subject", "path.chapter")).alias("chosen"), F.concat_ws("/", "className", "subject", "path.chapter").alias("guessed"))
    return syllabus.topics_allowed(q, table(s, d, "syllabus")).select("id", F.size("topics").alias("topics"))


def accepted_tags(s, d):
    q = _latest(s, d, "path")
    key = F.concat_ws("/", "className", "subject", "path.chapter")
    allowed = q.select("id", F.lit(None).cast("array<string>").alias("own"), key.alias("chosen"), F.lit(None).cast("string").alias("guessed"))
    answers = q.select("id", F.col("id").alias("key"), "topic", F.upper("level").alias("level"))
    return syllabus.accepted_tags(answers, syllabus.topics_allowed(allowed, table(s, d, "syllabus"))).select("id", "topic", "level", "placed")


def to_tag(s, d):
    return review.to_tag(_latest(s, d)).select("id")


def same_file_twice(s, d):
    return sets.same_file_twice(table(s, d, "ingest_document"))


def duplicate_uploads(s, d):
    """Extracted files are known; every file is asked about."""
    f = table(s, d, "ingest_document").select("doc_no", "documentId", "fileName", "pdfSha256", "status").distinct()
    known = f.where("status = 'extracted'").select(F.col("documentId").alias("file_id"), "fileName", F.col("pdfSha256").alias("sha"), F.col("doc_no").alias("pos"))
    up = f.drop("status").distinct().select(F.concat_ws("|", "documentId", "fileName").alias("upload_id"), "fileName", F.col("pdfSha256").alias("sha"))
    return sets.duplicates_of_files(up, known)


def active_sessions(s, d):
    i = table(s, d, "ingest_document")
    sessions = i.where("sessionId is not null").groupBy("sessionId").agg(F.max("deletedAt").alias("deletedAt"))
    return sets.active_links(i, sessions)


def parents_missing_or_stale(s, d):
    return sets.missing_and_stale(table(s, d, "question").select("documentId"), table(s, d, "ingest_document").select("documentId"), "documentId")


def newest_documents(s, d):
    i = review.latest(table(s, d, "ingest_document").select("documentId", "fileName", "status", "updatedAt"), ["documentId"], ["updatedAt", "fileName", "status"])
    return sets.top_n(i, 20, F.desc("updatedAt"), "documentId")


def document_status(s, d):
    return R.latest_state(table(s, d, "ingest_document"), "documentId", "status", ["updatedAt", "fileName", "status"]).select("documentId", "status")


def stage_counts(s, d):
    return R.stages(document_status(s, d).withColumnRenamed("status", "stage"))


def chapter_options(s, d):
    c = R.distinct_options([(table(s, d, "ingest_document"), "chapter"), (table(s, d, "syllabus"), "chapter"), (table(s, d, "ingest_document"), "module")], "chapter", ("Core", "Appendix"))
    return c.select("field", "value")


def document_signatures(s, d):
    q = table(s, d, "question").where("documentId is not null and id is not null").select("documentId", "id", "stem", "answer", "explanation", "questionType").distinct()
    return R.signature(q, "documentId", ["id", "stem", "answer", "explanation", "questionType"])


def object_names(s, d):
    q = table(s, d, "question").select("id", "imageCrops").distinct()
    return export.object_names(q).select("id", "url", "file", "object")


def rewritten_records(s, d):
    q = table(s, d, "question").where("id is not null").dropDuplicates(["id"])
    m = export.object_names(q).select("id", "url", F.concat(F.lit("https://store.example/"), "object").alias("new_url"))
    r = export.rewritten_urls(q, m)
    return r.select("id", F.array_join("images", "|").alias("images"), "questionImage", F.array_join(F.transform("imageCrops", lambda c: c["url"]), "|").alias("crops"), F.array_join("explanationImages", "|").alias("explanation_images"))


def stored_documents(s, d):
    q = table(s, d, "question").where("id is not null").select("id", "path", "exam", "answerImages", "explanationImages", "imageCrops", "createdAt", "updatedAt").distinct()
    t = export.to_documents(q)
    return t.select("id", "exam", F.col("path.section").alias("section"), F.unix_millis("createdAt").alias("created_ms"), F.size("explanationImages").alias("n")).distinct()


def record_upsert(s, d):
    """First pushes as the base, later pushes as updates."""
    q = table(s, d, "question").where("id is not null").select("id", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "createdAt", "updatedAt").distinct()
    base = R.keep_first(q, ["id"], ["updatedAt", "level", "flagged"]).where("level <> 'hard'").select("id", "level", "flagged", "createdAt", "updatedAt")
    return export.upserted(base, q, "id", ["updatedAt", "level", "flagged"], on_insert=("createdAt",))


def file_ids(s, d):
    i = table(s, d, "ingest_document").select("documentId", "driveFileId", "sessionId", "status").distinct()
    return i.select("documentId", "status", sets.drive_id(F.when(F.col("status") == "queued", F.concat(F.lit("local:"), "documentId")).otherwise(F.col("driveFileId")), F.lit(""), "sessionId", F.concat(F.lit("d-"), "documentId")).alias("file_id")).distinct()


def prose_retention(s, d):
    q = table(s, d, "question").where("explanation is not null").select("id", F.col("explanation").alias("original"), F.col("stem").alias("rewritten")).distinct().dropDuplicates(["id"])
    return review.retention(q).select("id", F.col("kept").cast("bigint").alias("kept"), F.col("original").cast("bigint").alias("original"), "accepted")


def shared_words(s, d):
    q = table(s, d, "question").where("explanation is not null").select("id", F.col("stem").alias("a"), F.col("explanation").alias("b")).distinct().dropDuplicates(["id"])
    return sets.shared_words(q).select("id", F.col("common").cast("bigint").alias("common"))


def file_slugs(s, d):
    i = table(s, d, "ingest_document").select("documentId", "fileName").distinct()
    return i.select("documentId", "fileName", X.bundle_name("fileName", "documentId").alias("bundle"), X.file_stem("fileName").alias("stem"), X.safe_name("fileName").alias("safe"))


def class_names(s, d):
    i = table(s, d, "ingest_document").select("documentId", "fileName").distinct()
    return i.select("documentId", "fileName", X.class_name(F.regexp_replace("fileName", "_", " ")).alias("class_name"))


def class_counts(s, d):
    return sinks.class_counts(table(s, d, "ingest_document").select("documentId", "className", "subject").distinct())


def drive_paths(s, d):
    i = table(s, d, "ingest_document").select("documentId", "exam", "subject", "module", "chapter").distinct()
    return i.select("documentId", sinks.drive_path("exam", "subject", "module", "chapter").alias("path")).distinct()


def effective_fields(s, d):
    """Question values over document values over a default: false and 0 count, empty texts do not."""
    q = _latest(s, d).select("id", "documentId", F.nullif("subject", F.lit("Maths")).alias("m"))
    i = review.latest(table(s, d, "ingest_document").select("documentId", "subject", "updatedAt", "fileName"), ["documentId"], ["updatedAt", "fileName"])
    j = q.join(i.select("documentId", F.col("subject").alias("doc")), "documentId", "left")
    return j.select("id", review.pick("m", "doc", F.lit("Unknown")).alias("subject"))


def valid_regions(s, d):
    q = table(s, d, "question").where("sourceRegion is not null").select("id", F.col("sourceRegion.bbox").alias("b")).distinct()
    return q.select("id", G.valid_selection("b").alias("valid")).distinct()


def page_links(s, d):
    """Link lists made of the documents, one page per session."""
    i = table(s, d, "ingest_document").where("sessionId is not null").select("sessionId", "doc_no", "chapter").distinct()
    a = F.concat(F.lit('<a href="/viewer/'), F.lower(F.regexp_replace(F.coalesce("chapter", F.lit("none")), "[^A-Za-z]+", "-")), F.lit("/"), F.col("doc_no").cast("string"), F.lit('">x</a>'))
    p = i.groupBy(F.col("sessionId").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(a)), " ").alias("html"))
    return sets.links_in(p, r'href="(/viewer/[^"]*/\d+)"').select("page_id", "url", "slug", "id")


QUERIES = {f.__name__: f for f in (latest_records, document_parents, missing_fields, export_gate, exam_names, inline_options, marked_options, previous_years, id_stamps, title_guess, exact_chapter, fuzzy_chapter, syllabus_chapters, allowed_topics, accepted_tags, to_tag, same_file_twice, duplicate_uploads, active_sessions, parents_missing_or_stale, newest_documents, document_status, stage_counts, chapter_options, document_signatures, object_names, rewritten_records, stored_documents, record_upsert, file_ids, prose_retention, shared_words, file_slugs, class_names, class_counts, drive_paths, effective_fields, valid_regions, page_links)}

_LATEST = "lq as (select * from (select *, row_number() over (partition by id order by \"updatedAt\" desc, coalesce(level, '') desc, coalesce(flagged, false) desc) as rn from question where id is not null) where rn = 1)"
_EXAM = "case lower(trim(exam)) when 'board' then 'BOARDS' when 'boards' then 'BOARDS' when 'jee' then 'JEE' when 'neet' then 'NEET' else nullif(trim(exam), '') end"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+', 0), lambda w: w not in ('and','the','of','in','to','a','an','its','our')))"
_CHAPTERS = "ch as (select \"className\" || '/' || subject || '/' || chapter as key, any_value(\"className\") as cls, any_value(subject) as subj, any_value(chapter) as chapter, list(topic order by pos) as topics from syllabus group by 1)"
_PROSE = "regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({}, '\\\\\\(.+?\\\\\\)|\\\\\\[.+?\\\\\\]|\\$[^$]+\\$', ' ', 'gs'), '!\\[\\]\\([^)]+\\)', ' ', 'g'), '\\\\[A-Za-z]+\\*?', ' ', 'g')), '[a-z]{{3,}}', 0)"
_CROPS = "cr as (select id, c.url as url, c.type as type, i - 1 as i from (select distinct id, \"imageCrops\" as cs from question) q, range(1, len(cs) + 1) as t(i), lateral (select cs[i] as c) x where coalesce(cs[i].url, '') <> ''), ob as (select id, url, max(i) as i, arg_max(type, i) as type from cr group by all), nm as (select id, url, regexp_replace(url, '^.*/', '') as file, id || '_' || (case when type = 'option' then 'option' else 'question' end) || '_' || i || '_' || (('0x' || substr(id, 1, 8))::bigint * 1000) as object from ob)"
_FSTEM = "regexp_replace(regexp_replace(\"fileName\", '^.*[/\\\\]', ''), '\\.[^.]*$', '')"
_CHAP = f"trim(regexp_replace({_FSTEM}, '^Chapter\\s*\\d+\\s*-\\s*', '', 'i'))"
_ILATEST = "il as (select * from (select *, row_number() over (partition by \"documentId\" order by \"updatedAt\" desc, \"fileName\" desc, status desc) as rn from ingest_document) where rn = 1)"

SQL = {
    "latest_records": f'with {_LATEST} select id, "documentId", "questionType", level, flagged, "updatedAt" from lq',
    "document_parents": f"""with o as (select *, row_number() over (partition by "documentId", id order by "updatedAt" desc) as rn from question where "documentId" is not null and id is not null), p as (select * from o where rn = 1),
  md as (select "documentId", "questionType" from (select "documentId", "questionType", row_number() over (partition by "documentId" order by count(*) desc, "questionType") as r from p where "questionType" is not null group by 1, 2) where r = 1),
  hd as (select "documentId", subject, "className", {_EXAM} as exam, path.chapter as chapter from (select *, row_number() over (partition by "documentId" order by "createdAt", id) as r from p) where r = 1),
  ct as (select "documentId", count(*) as "questionCount", bool_or(coalesce("isPyq", false)) as pyq from p group by 1)
  select ct."documentId", "questionCount", "questionType", pyq, subject, "className", exam, chapter from ct join hd using ("documentId") left join md using ("documentId")""",
    "missing_fields": f"""with {_LATEST} select * from (select id, concat_ws(',', case when coalesce(subject, '') = '' then 'subject' end, case when coalesce(topic, '') = '' then 'topic' end, case when coalesce(level, '') = '' then 'level' end, case when coalesce("questionType", '') = '' then 'questionType' end,
  case when coalesce(path.module, '') = '' then 'module' end, case when coalesce(path.chapter, '') = '' then 'chapter' end) as missing from lq) where missing <> ''""",
    "export_gate": f"""with {_LATEST}, g as (select count(*) as records, count(*) filter (coalesce(subject, '') = '' or coalesce(topic, '') = '' or coalesce(level, '') = '' or coalesce("questionType", '') = '' or coalesce(path.module, '') = '' or coalesce(path.chapter, '') = '') as incomplete, count(*) filter (coalesce(flagged, false)) as flagged from lq)
  select *, records > 0 and incomplete = 0 and flagged = 0 as passes from g""",
    "exam_names": f"select distinct exam, {_EXAM} as normal from question",
    "inline_options": r"""with q as (select distinct id, "questionType" as qt, coalesce(stem, '') || chr(10) || array_to_string(list_transform(options, lambda o: '(' || lower(o.label) || ') ' || coalesce(o.body, '')), '  ') as t from question),
  s as (select *, list_transform(regexp_extract_all(t, '(?:^|\s)[\(\[]?([a-dA-D])[\)\].]\s+', 1), lambda l: upper(l)) as ls, regexp_split_to_array(t, '(?:^|\s)[\(\[]?([a-dA-D])[\)\].]\s+') as ps from q),
  u as (select *, list_transform(ps[2:], lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')) as bs from s),
  v as (select *, coalesce(qt in ('single_correct', 'multiple_correct', 'multi_correct', 'assertion_reason', 'true_false') and len(ls) >= 2 and ls[1] = 'A' and len(list_distinct(ls)) = len(ls) and not list_contains(bs, ''), false) as ok from u)
  select distinct id, case when ok then len(ls) else 0 end::int as n, case when ok then array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || '=' || bs[i]), '|') else '' end as options, md5(case when ok then regexp_replace(ps[1], '^\s+|\s+$', '', 'g') else t end) as stem_md5 from v""",
    "marked_options": "select distinct id, case when regexp_matches(answer, '^[A-Da-d]$') and list_contains(list_transform(options, lambda o: o.label), upper(answer)) then upper(answer) else '' end as ticked from question where len(options) > 0",
    "previous_years": r"""with q as (select distinct id, '[' || coalesce(exam, '') || ' Main, ' || coalesce("pyqYear", 0) || ']' as t from question), p as (select id, t, '\[?\(?\b(JEE(?:[ -]?(?:Main|Mains|Advanced|Adv))?|AIEEE|IIT[- ]?JEE|NEET|AIPMT|CBSE|NSEC|BITSAT)\b[^\]\)\n]{0,20}?\b((?:19|20)\d{2})\b' as rx from q)
  select id, nullif(replace(upper(regexp_extract(t, '\[?\(?\b(JEE(?:[ -]?(?:Main|Mains|Advanced|Adv))?|AIEEE|IIT[- ]?JEE|NEET|AIPMT|CBSE|NSEC|BITSAT)\b[^\]\)\n]{0,20}?\b((?:19|20)\d{2})\b', 1, 'i')), ' ', '-'), '') as exam, try_cast(nullif(regexp_extract(t, '\[?\(?\b(JEE(?:[ -]?(?:Main|Mains|Advanced|Adv))?|AIEEE|IIT[- ]?JEE|NEET|AIPMT|CBSE|NSEC|BITSAT)\b[^\]\)\n]{0,20}?\b((?:19|20)\d{2})\b', 2, 'i'), '') as int) as year from p""",
    "id_stamps": "select distinct id, ('0x' || substr(id, 1, 8))::bigint * 1000 as stamp from question where id is not null",
    "title_guess": rf"""with {_CHAPTERS}, t as (select distinct "documentId" || '|' || "fileName" as id, trim(regexp_replace(replace({_FSTEM}, '_', ' '), '^class \d+ (maths|physics|chemistry|biology) | \(\d+\)$', '', 'gi')) as title, subject, "className" as hint from ingest_document),
  w as (select t.*, ch.*, {_WORDS.format("title")} as a, {_WORDS.format("ch.chapter")} as b from t join ch on hint is null or lower(hint) = lower(cls)),
  sc as (select id, key, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) - case when subject is not null and subject <> '' and not contains(lower(subject), lower(subj)) and not contains(lower(subj), lower(subject)) then 0.15::double else 0.0::double end as score, len(list_intersect(a, b)) as n from w),
  r as (select *, row_number() over (partition by id order by score desc, key) as rn, lead(score) over (partition by id order by score desc, key) as nxt from sc where n > 0),
  g as (select * from r where rn = 1 and score >= 0.6 and (nxt is null or nxt < score - 0.01::double))
  select t.id, g.key, g.score from t left join g using (id)""",
    "exact_chapter": f"""with {_CHAPTERS} select t.id, ch.key from (select distinct "documentId" as id, "className" || '/' || subject || '/' || chapter as k from ingest_document where "className" is not null and subject is not null and chapter is not null) t left join ch on lower(ch.key) = lower(t.k)""",
    "fuzzy_chapter": f"""with t as (select distinct chapter as id, {_WORDS.format("substr(chapter, 2)")} as w from ingest_document where chapter is not null), c as (select distinct chapter as candidate, {_WORDS.format("chapter")} as cw, ('0x' || substr(md5(chapter), 1, 7))::bigint as ord from syllabus),
  h as (select id, candidate, ord, w, cw, len(list_filter(w, lambda a: len(list_filter(cw, lambda b: a = b or (length(a) > 3 and length(b) > 3 and (suffix(a, b) or suffix(b, a)) and abs(length(a) - length(b)) <= 2))) > 0)) as hits from t, c),
  s as (select *, hits / greatest(len(list_distinct(list_concat(w, cw))), 1) as score from h)
  select id, candidate, score from (select *, row_number() over (partition by id order by score desc, ord) as r from s where score >= 0.5) where r = 1""",
    "syllabus_chapters": f"with {_CHAPTERS} select key, array_to_string(topics, '; ') as topics from ch",
    "allowed_topics": f"""with {_LATEST}, {_CHAPTERS}, k as (select id, concat_ws('/', "className", subject, path.chapter) as key from lq) select id, coalesce(len(ch.topics), 0)::int as topics from k left join ch using (key)""",
    "accepted_tags": f"""with {_LATEST}, {_CHAPTERS}, k as (select id, topic, level, concat_ws('/', "className", subject, path.chapter) as key from lq)
  select id, case when list_contains(ch.topics, topic) then topic end as topic, level, coalesce(list_contains(ch.topics, topic), false) and level is not null as placed from k left join ch using (key)""",
    "to_tag": f"with {_LATEST} select id from lq where coalesce(topic, '') = '' or coalesce(level, '') = ''",
    "same_file_twice": """with f as (select "documentId", "pdfSha256" as h, min("createdAt") as c from ingest_document where "pdfSha256" is not null group by all), r as (select *, first_value("documentId") over (partition by h order by c, "documentId") as first_id, count(*) over (partition by h) as n from f)
  select "documentId", first_id from r where n > 1 and "documentId" <> first_id""",
    "duplicate_uploads": """with u as (select distinct doc_no, "documentId", "fileName", "pdfSha256" as sha from ingest_document), k as (select distinct doc_no, "documentId", "fileName", "pdfSha256" as sha from ingest_document where status = 'extracted'),
  s as (select sha, arg_min("documentId", (doc_no, "documentId")) as hit from k where sha is not null group by sha), n as (select lower("fileName") as name, arg_min("documentId", (doc_no, "documentId")) as hit from k where sha is null group by 1)
  select u."documentId" || '|' || u."fileName" as upload_id, coalesce(s.hit, n.hit) as file_id, case when s.hit is not null then 'content' when n.hit is not null then 'filename' end as match from u left join s on s.sha = u.sha left join n on n.name = lower(u."fileName")""",
    "active_sessions": """with s as (select "sessionId" from ingest_document where "sessionId" is not null group by 1 having max("deletedAt") is null) select distinct "documentId", "sessionId" from ingest_document semi join s using ("sessionId") where regexp_matches("documentId", '^[0-9a-fA-F]{24}$')""",
    "parents_missing_or_stale": """select "documentId", 'missing' as state from (select distinct "documentId" from question where "documentId" is not null) anti join ingest_document using ("documentId") union all select "documentId", 'stale' from (select distinct "documentId" from ingest_document where "documentId" is not null) anti join question using ("documentId")""",
    "newest_documents": f'with {_ILATEST} select "documentId", "fileName", status, "updatedAt" from il order by "updatedAt" desc, "documentId" limit 20',
    "document_status": f'with {_ILATEST} select "documentId", status from il',
    "stage_counts": f"with {_ILATEST} select status as stage, count(*) as n from il group by 1",
    "chapter_options": "select distinct 'chapter' as field, trim(v) as value from (select chapter as v from ingest_document union all select chapter from syllabus union all select module from ingest_document union all values ('Core'), ('Appendix')) where trim(v) <> ''",
    "document_signatures": """with q as (select distinct "documentId", id, stem, answer, explanation, "questionType" from question where "documentId" is not null and id is not null), h as (select "documentId", sha256(id || chr(31) || coalesce(stem, chr(0)) || chr(31) || coalesce(answer, chr(0)) || chr(31) || coalesce(explanation, chr(0)) || chr(31) || coalesce("questionType", chr(0))) as h from q),
  b as (select "documentId", substr(h, 1, 3) as k, sha256(string_agg(h, chr(10) order by h)) as d, count(*) as n from h group by 1, 2)
  select "documentId", sha256(string_agg(k || d, chr(10) order by k)) as signature, sum(n)::bigint as records from b group by 1""",
    "object_names": f"with {_CROPS} select id, url, file, object from nm",
    "rewritten_records": f"""with {_CROPS}, mp as (select id, map_from_entries(list((url, 'https://store.example/' || object))) as m from nm group by id), q as (select * from (select *, row_number() over (partition by id order by "updatedAt") as rn from question where id is not null) where rn = 1)
  select q.id, array_to_string(list_transform(images, lambda u: coalesce(m[u], u)), '|') as images, case when "questionImage" is not null then coalesce(m["questionImage"], "questionImage") end as "questionImage", array_to_string(list_transform("imageCrops", lambda c: coalesce(m[c.url], c.url)), '|') as crops, array_to_string(list_transform("explanationImages", lambda u: coalesce(m[u], u)), '|') as explanation_images from q left join mp using (id)""",
    "stored_documents": f"""select distinct id, {_EXAM} as exam, coalesce(nullif(path.section, ''), 'All sections') as section, epoch_ms("createdAt"::timestamp) as created_ms, coalesce(len("explanationImages"), 0)::int as n from question where id is not null""",
    "record_upsert": """with q as (select distinct id, coalesce(level, '') as level, coalesce(flagged, false) as flagged, "createdAt", "updatedAt" from question where id is not null),
  b as (select * from (select *, row_number() over (partition by id order by "updatedAt", level, flagged) as r from q) where r = 1 and level <> 'hard'), u as (select * from (select *, row_number() over (partition by id order by "updatedAt" desc, level desc, flagged desc) as r from q) where r = 1)
  select u.id, u.level, u.flagged, coalesce(b."createdAt", u."createdAt") as "createdAt", u."updatedAt", case when b.id is null then 'new' else 'updated' end as action from u left join b using (id)""",
    "file_ids": """select distinct "documentId", status, coalesce(case when status = 'queued' then null when coalesce("driveFileId", '') <> '' and "driveFileId" not like 'local:%' then "driveFileId" end, case when coalesce("sessionId", '') <> '' and "sessionId" not like 'local:%' then "sessionId" end, 'd-' || "documentId") as file_id from ingest_document""",
    "prose_retention": f"""with q as (select id, any_value(explanation) as o, any_value(stem) as r from question where explanation is not null group by id), a as (select id, w, count(*) as n from (select id, unnest({_PROSE.format("o")}) as w from q) group by all), b as (select id, w, count(*) as m from (select id, unnest({_PROSE.format("coalesce(r, '')")}) as w from q) group by all),
  s as (select a.id, sum(n)::bigint as original, sum(least(n, coalesce(m, 0)))::bigint as kept from a left join b using (id, w) group by a.id) select q.id, coalesce(kept, 0) as kept, coalesce(original, 0) as original, coalesce(original, 0) < 10 or coalesce(kept, 0) >= 0.8 * coalesce(original, 0) as accepted from q left join s using (id)""",
    "shared_words": f"""with q as (select id, any_value(explanation) as o, any_value(stem) as r from question where explanation is not null group by id), a as (select id, w, count(*) as n from (select id, unnest({_PROSE.format("o")}) as w from q) group by all), b as (select id, w, count(*) as m from (select id, unnest({_PROSE.format("coalesce(r, '')")}) as w from q) group by all)
  select id, sum(least(n, m))::bigint as common from a join b using (id, w) group by id""",
    "file_slugs": f"""select distinct "documentId", "fileName", coalesce(nullif(regexp_replace(regexp_replace({_CHAP}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), "documentId") as bundle, {_FSTEM} as stem, trim(regexp_replace("fileName", '[<>:"/\\\\|?*]+', '', 'g')) as safe from ingest_document""",
    "class_names": r"""with c as (select distinct "documentId", "fileName", upper(regexp_extract(replace("fileName", '_', ' '), 'class\s*[-–—:]?\s*(XII|XI|IX|X|VIII|VII|VI|\d{1,2})\b', 1, 'i')) as n from ingest_document) select "documentId", "fileName", case when n <> '' then 'Class ' || case n when 'VI' then '6' when 'VII' then '7' when 'VIII' then '8' when 'IX' then '9' when 'X' then '10' when 'XI' then '11' when 'XII' then '12' else n end end as class_name from c""",
    "class_counts": 'select "className", subject, count(*) as files from (select distinct "documentId", "className", subject from ingest_document) group by all',
    "drive_paths": """select distinct "documentId", concat_ws('/', nullif(trim(exam), ''), nullif(trim(subject), ''), nullif(trim(module), ''), nullif(trim(chapter), '')) as path from ingest_document""",
    "effective_fields": f"""with {_LATEST}, il as (select * from (select *, row_number() over (partition by "documentId" order by "updatedAt" desc, "fileName" desc) as rn from ingest_document) where rn = 1) select id, coalesce(nullif(nullif(lq.subject, 'Maths'), ''), nullif(il.subject, ''), 'Unknown') as subject from lq left join il using ("documentId")""",
    "valid_regions": """select distinct id, coalesce(len(b) = 4 and len(list_filter(b, lambda v: v is null or isnan(v) or v < 0 or v > 1)) = 0 and abs(b[3] - b[1]) * 612.0 >= 5 and abs(b[4] - b[2]) * 792.0 >= 5, false) as valid from (select id, "sourceRegion".bbox as b from question where "sourceRegion" is not null)""",
    "page_links": """select distinct "sessionId" as page_id, '/viewer/' || lower(regexp_replace(coalesce(chapter, 'none'), '[^A-Za-z]+', '-', 'g')) || '/' || doc_no as url, lower(regexp_replace(coalesce(chapter, 'none'), '[^A-Za-z]+', '-', 'g')) as slug, doc_no::varchar as id from ingest_document where "sessionId" is not null""",
}
