"""Queries over page lines and picture boxes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions import text as X
from quillmark.operators import clusters, export, images, lines, review, structure
from quillmark.operators import rollups as R
from quillmark.runtime import table, written


def _lines(s, d):
    return structure.without_page_numbers(table(s, d, "page_line"))


def section_split(s, d):
    return structure.sections(_lines(s, d)).select("doc_id", "exercise", "title", "question", "label", "number", "page_start", "heading", "question_text", "solution_text", "lines")


def question_keys(s, d):
    return structure.question_keys(structure.sections(_lines(s, d))).select("doc_id", "key", "name")


def line_regions(s, d):
    return structure.regions(_lines(s, d))


def margin_page_numbers(s, d):
    t = table(s, d, "page_line")
    margin = (F.col("bottom") > 0.92 * 792.0) | (F.col("top") < 0.05 * 792.0)
    return t.where(F.coalesce(margin & F.col("text").rlike(structure.PAGE_NUMBER), F.lit(False))).select("doc_id", "line_no", "page", "text").distinct()


def next_slot(s, d):
    t = _lines(s, d)
    return structure.slot_for(structure.sections(t), t)


def markdown(s, d):
    return structure.markdown(structure.sections(_lines(s, d)))


def line_height(s, d):
    return lines.upper_median_height(table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"]))


def line_batches(s, d):
    t = table(s, d, "page_line").dropDuplicates(["doc_id", "line_no"])
    return R.numbered_batches(t.select("doc_id", "line_no"), "doc_id", ["line_no"], 12, F.floor(F.col("line_no") / structure.BLOCK))


def image_tokens(s, d):
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    return t.select("doc_id", "line_no", F.posexplode(X.image_names("text")).alias("pos", "name"), X.tokens_to_markdown("text").alias("markdown"))


def stripped_text(s, d):
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    return t.select("doc_id", "line_no", X.strip_images(X.tokens_to_markdown("text")).alias("text"))


def near_boxes(s, d):
    return images.near_pairs(table(s, d, "image_box"))


def image_aliases(s, d):
    return images.aliases(table(s, d, "image_box"))


def deduplicated_sections(s, d):
    t = table(s, d, "page_line").where("text is not null").select("doc_id", F.concat_ws("-", "page").alias("key"), "line_no", "text").dropDuplicates(["doc_id", "line_no"])
    sec = t.groupBy("doc_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return images.without_aliases(sec, images.aliases(table(s, d, "image_box")))


def rounded_boxes(s, d):
    b = table(s, d, "image_box").where("bbox is not null").select("doc_id", "name", "page", G.normalised("bbox", F.lit(612.0), F.lit(792.0)).alias("n"))
    return b.select("doc_id", "name", "page", *(F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("x0", "top", "x1", "bottom"))))


def crop_pixels(s, d):
    b = table(s, d, "image_box").where("bbox is not null").select("doc_id", "name", G.crop_pixels(G.normalised("bbox", F.lit(612.0), F.lit(792.0))).alias("p"))
    return b.select("doc_id", "name", "p.nx", "p.ny", "p.nw", "p.nh")


def drawings(s, d):
    return clusters.drawings(table(s, d, "image_box"))


def folded_lines(s, d):
    """Words of the lines and pictures of the boxes as tokens, built to lines again."""
    t = table(s, d, "page_line").where("text is not null and not text like '[[eq%'").dropDuplicates(["doc_id", "line_no"])
    words = t.select("doc_id", "page", F.lit("text").alias("kind"), F.posexplode(F.split("text", " ")).alias("i", "value"), "x0", "top", "bottom")
    words = words.select("doc_id", "page", "kind", "value", (F.col("x0") + F.col("i") * 30).alias("x0"), (F.col("x0") + F.col("i") * 30 + 25).alias("x1"), "top", "bottom")
    b = table(s, d, "image_box").where("size(bbox) = 4").select("doc_id", "page", F.lit("eq").alias("kind"), F.col("name").alias("value"), G.part("bbox", 0).alias("x0"), G.part("bbox", 2).alias("x1"), G.part("bbox", 1).alias("top"), G.part("bbox", 3).alias("bottom"))
    return lines.fold_lines(words.unionByName(b))


def scanned_pages(s, d):
    w = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"]).groupBy("doc_id", "page").agg(F.sum(F.size(F.split("text", " "))).alias("words"))
    b = table(s, d, "image_box").groupBy("doc_id", "page").agg(F.sum(G.area("bbox")).alias("picture_area"))
    p = w.join(b, ["doc_id", "page"], "full_outer").withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "outlines": F.lit(0)})
    return lines.scanned_pages(p).select("doc_id", "page", "scanned")


def figures_in_questions(s, d):
    r = structure.regions(_lines(s, d)).select("doc_id", "page", F.concat_ws("-", "exercise", "question").alias("sel_id"), F.array("x0", "top", "x1", "bottom").alias("area"))
    return images.figures_in(r, table(s, d, "image_box"))


def recognised(s, d):
    """The cascade on features derived from the boxes (no pictures are at hand)."""
    b = table(s, d, "image_box").where("size(bbox) = 4")
    w, h = G.part("bbox", 2) - G.part("bbox", 0), G.part("bbox", 3) - G.part("bbox", 1)
    k = F.regexp_extract("name", r"eq(\d+)", 1).cast("int") + F.col("doc_id")
    f = b.select(
        F.concat_ws("/", "doc_id", "name").alias("name"), F.md5(F.concat_ws("/", "doc_id", "name")).alias("md5"), w.alias("width"), h.alias("height"),
        F.when(k % 7 == 0, "coloured").alias("figure_reason"), (k % 11 == 0).alias("is_scan"), F.lit("x").alias("glyph"), ((k % 10) / 10.0).alias("glyph_score"), F.when(k % 5 != 0, F.concat(F.lit("y_"), k)).alias("model_latex"),
    )
    return images.recognise(f).select("name", "source", "latex", "needs_review")


def remapped(s, d):
    """Keys before and after a re-split in which some headings were not seen."""
    t = _lines(s, d)
    return review.remap(structure.sections(t), structure.sections(t.where("not text like 'ADDITIONAL%' and not text like 'Q%3%'")))


def export_records(s, d):
    m = written(structure.marked(_lines(s, d)), "marked")  # read twice: by sections and by regions
    q = structure.sections_of(m)
    manual = s.createDataFrame([], export.MANUAL)
    doc = q.select("doc_id").distinct().select("doc_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in s.createDataFrame([], export.DOCUMENT).schema.fields if f.name != "doc_id"))
    r = export.records(q, manual, doc, structure.regions_of(m), table(s, d, "image_box"), "2024-01-01T00:00:00.000Z")
    return r.select("id", "questionNumber", "stem", "answer", "explanation", "sectionName", "flagged", F.size("images").alias("n_images"), F.size("imageCrops").alias("n_crops"), F.col("sourceRegion.page").alias("page"))


def audited_questions(s, d):
    """A page audit that reports every numbered question of a page, known or not; letter labels are not known by number."""
    q = structure.sections(_lines(s, d))
    found = q.where("number is not null").select("doc_id", F.col("page_start").alias("page"), "number", F.col("question").alias("pos"))
    known = q.where("heading = 'answer'").select("doc_id", F.col("page_start").alias("page"), "label")
    return review.audited(found, known).select("doc_id", "page", "number", "label")


QUERIES = {f.__name__: f for f in (section_split, question_keys, line_regions, margin_page_numbers, next_slot, markdown, line_height, line_batches, image_tokens, stripped_text, near_boxes, image_aliases, deduplicated_sections, rounded_boxes, crop_pixels, drawings, folded_lines, scanned_pages, figures_in_questions, recognised, remapped, export_records, audited_questions)}

_Q = r"^(?:Question|Ques\.?|Q\.)\s*([A-Z]?\d+(?:\.\d+)*)\s*[:.)]?"
_S = r"^(?:(Solution|Answer|Sol|Ans)\s*(?:[A-Z]?\d+(?:\.\d+)*)?\s*(?::|-|$)|(Sol|Ans)\.)"
_E = r"^(EXERCISE\s+[\d.]+|MISCELLANEOUS EXERCISE|ADDITIONAL EXERCISES)\b|^(EXERCISE)\s*$"
_P = r"^(?:page\s*)?[-–(]?\s*\d{1,4}\s*[-–)]?(?:\s*(?:of|/)\s*\d{1,4})?$"
#: The splitter in SQL, up to marked lines: m(doc_id, line_no, page, ..., exercise, question, title, label, heading, section, content).
MARKED = rf"""
a as (select *, row_number() over (partition by doc_id, line_no order by page) as rn from page_line where text is not null),
b as (select * from a where rn = 1 and not coalesce((bottom > 728.64 or top < 39.6) and regexp_matches(text, '{_P}', 'i'), false)),
c as (select *, regexp_extract(text, '^(?:\[\[eq:[^\]]+\]\]\s*)+', 0) as lead0 from b),
e as (select *, trim(lead0) as lead_, substr(text, length(lead0) + 1) as core from c),
f0 as (select *, regexp_matches(core, '^Chapter\s+\d+.*', 'i') as is_ch from e),
f1 as (select *, sum(is_ch::int) over (partition by doc_id order by line_no) as n_ch from f0),
f as (select *, regexp_matches(core, '{_E}', 'i') as is_ex from f1 where not (is_ch and n_ch = 1)),
g as (select *, (not is_ex and regexp_matches(core, '{_Q}', 'i')) as is_q from f),
h as (select *, sum(is_ex::int) over (partition by doc_id order by line_no) as headed from g),
i as (select *, max((is_q and headed = 0)::int) over (partition by doc_id) as orphan, sum(is_q::int) over (partition by doc_id, headed order by line_no) - 1 as qn,
  coalesce(first_value(case when is_ex then upper(coalesce(nullif(regexp_extract(core, '{_E}', 1, 'i'), ''), regexp_extract(core, '{_E}', 2, 'i'))) end) over (partition by doc_id, headed order by line_no), 'UNKNOWN') as title from h),
j as (select *, (headed - 1 + orphan)::bigint as exercise, qn::bigint as question from i where qn >= 0 and not is_ex),
k as (select *, (not is_q and regexp_matches(core, '{_S}', 'i')) as is_sol from j),
l as (select *, min(case when is_sol then line_no end) over (partition by doc_id, headed, question) as sol_at from k),
m as (select *, case when line_no >= sol_at then 'solution' else 'question' end as section,
  max(case when is_q then regexp_extract(core, '{_Q}', 1, 'i') end) over (partition by doc_id, headed, question) as label,
  max(case when is_sol and line_no = sol_at then case when lower(coalesce(nullif(regexp_extract(core, '{_S}', 1, 'i'), ''), regexp_extract(core, '{_S}', 2, 'i'))) like 'ans%' then 'answer' else 'solution' end end) over (partition by doc_id, headed, question) as heading,
  case when is_q then trim(concat_ws(' ', nullif(lead_, ''), nullif(trim(regexp_replace(core, '{_Q}', '', 'i')), '')))
       when is_sol and line_no = sol_at then trim(concat_ws(' ', nullif(lead_, ''), nullif(trim(regexp_replace(core, '{_S}', '', 'i')), ''))) else text end as content from l)
"""
SECTIONS = (
    "with "
    + MARKED
    + """, sec as (select doc_id, exercise, max(title) as title, question, max(label) as label, try_cast(nullif(regexp_extract(max(label), '(\\d+)$', 1), '') as int) as number, arg_min(page, line_no) as page_start, max(heading) as heading,
  coalesce(string_agg(content, chr(10) order by line_no) filter (section = 'question' and content <> ''), '') as question_text, coalesce(string_agg(content, chr(10) order by line_no) filter (section = 'solution' and content <> ''), '') as solution_text, count(*) as lines
  from m group by doc_id, exercise, question)
"""
)
_REG = """, reg as (select doc_id, exercise, question, page, floor(min(x0) * 10.0 + 0.5) / 10.0 as x0, floor(min(top) * 10.0 + 0.5) / 10.0 as top, floor(max(x1) * 10.0 + 0.5) / 10.0 as x1, floor(max(bottom) * 10.0 + 0.5) / 10.0 as bottom
  from m where x0 is not null and x1 is not null and top is not null and bottom is not null group by all)
"""
_ONE = "p as (select * from (select *, row_number() over (partition by doc_id, line_no order by page) as rn from page_line where text is not null) where rn = 1)"
_BOX = "bx as (select *, bbox[1] as ax, bbox[2] as ay, bbox[3] as bx, bbox[4] as by_ from image_box where len(bbox) = 4)"
_NORM = "floor(greatest(0.0, bbox[1] / 612.0) * 10000.0 + 0.5) / 10000.0 as x0, floor(greatest(0.0, bbox[2] / 792.0) * 10000.0 + 0.5) / 10000.0 as top, floor(least(1.0, bbox[3] / 612.0) * 10000.0 + 0.5) / 10000.0 as x1, floor(least(1.0, bbox[4] / 792.0) * 10000.0 + 0.5) / 10000.0 as bottom"

SQL = {
    "section_split": SECTIONS + "select * from sec",
    "question_keys": SECTIONS + "select doc_id, exercise || '-' || question as key, replace(title, ' ', '_') || '_Q' || label as name from sec",
    "line_regions": SECTIONS + _REG + "select * from reg",
    "margin_page_numbers": f"select distinct doc_id, line_no, page, text from page_line where (bottom > 728.64 or top < 39.6) and regexp_matches(text, '{_P}', 'i')",
    "next_slot": SECTIONS
    + """, per as (select doc_id, page_start as page, exercise, count(*) as n from sec group by all),
  best as (select doc_id, page, exercise from (select *, row_number() over (partition by doc_id, page order by n desc, exercise) as r from per) where r = 1),
  nx as (select doc_id, exercise, coalesce(max(number), 0) + 1 as next_number from sec group by all), last as (select doc_id, max(exercise) as last from sec group by doc_id),
  pg as (select distinct doc_id, page from b where page is not null)
  select pg.doc_id, pg.page, nx.exercise, nx.next_number from pg left join best using (doc_id, page) join last on last.doc_id = pg.doc_id join nx on nx.doc_id = pg.doc_id and nx.exercise = coalesce(best.exercise, last.last)""",
    "markdown": SECTIONS
    + r""", body as (select doc_id, exercise, question, (case when row_number() over (partition by doc_id, exercise order by question) = 1 then chr(10) || '## ' || title || chr(10) else '' end) || chr(10) || '### Question ' || label || '  (page ' || page_start || ')' || chr(10) || chr(10) || '**Question**' || chr(10) || chr(10)
  || replace(regexp_replace(question_text, '\[\[eq:([^\]]+)\]\]', '![](images/\1)', 'g'), chr(10), '  ' || chr(10)) || chr(10) || chr(10) || '**Solution**' || chr(10) || chr(10) || replace(regexp_replace(solution_text, '\[\[eq:([^\]]+)\]\]', '![](images/\1)', 'g'), chr(10), '  ' || chr(10)) || chr(10) as part from sec)
  select doc_id, string_agg(part, chr(10) order by exercise, question) as markdown from body group by doc_id""",
    "line_height": f"with {_ONE} select doc_id, page, coalesce(list_sort(list(bottom - top) filter (bottom - top is not null))[(count(bottom - top) // 2) + 1], 12.0) as height from p group by doc_id, page",
    "line_batches": "select doc_id, line_no, ((row_number() over (partition by doc_id order by line_no) - 1) // 12)::int as batch from (select distinct doc_id, line_no from page_line)",
    "image_tokens": f"with {_ONE} select doc_id, line_no, (i - 1)::int as pos, names[i] as name, regexp_replace(text, '\\[\\[eq:([^\\]]+)\\]\\]', '![](images/\\1)', 'g') as markdown from (select *, regexp_extract_all(text, '\\[\\[eq:([^\\]]+)\\]\\]', 1) as names from p), range(1, len(names) + 1) as t(i)",
    "stripped_text": f"with {_ONE} select doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[eq:([^\\]]+)\\]\\]', '![](images/\\1)', 'g'), '[ \\t]*!\\[\\]\\([^)\\s]*\\)[ \\t]*', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from p",
    "near_boxes": f"""with {_BOX}, u as (select * from bx where regexp_matches(name, '^p\\d+_eq\\d+\\.png$') and greatest(0, bx - ax) * greatest(0, by_ - ay) > 0)
  select a.doc_id, a.page, a.name as name_a, b.name as name_b from u a join u b on a.doc_id = b.doc_id and a.page = b.page and a.name < b.name
  where greatest(abs(a.ax - b.ax), abs(a.ay - b.ay), abs(a.bx - b.bx), abs(a.by_ - b.by_)) <= 2
  and (greatest(0, least(a.bx, b.bx) - greatest(a.ax, b.ax)) * greatest(0, least(a.by_, b.by_) - greatest(a.ay, b.ay))) / ((a.bx - a.ax) * (a.by_ - a.ay) + (b.bx - b.ax) * (b.by_ - b.ay) - greatest(0, least(a.bx, b.bx) - greatest(a.ax, b.ax)) * greatest(0, least(a.by_, b.by_) - greatest(a.ay, b.ay))) >= 0.9""",
    "rounded_boxes": f"select doc_id, name, page, {_NORM} from image_box where bbox is not null",
    "crop_pixels": f"""with n as (select doc_id, name, {_NORM} from image_box where bbox is not null), k as (select *, greatest((x1 - x0) * 612.0, 1e-6) as bw, greatest((bottom - top) * 792.0, 1e-6) as bh, 200 / 72 as k from n)
  select doc_id, name, floor(x0 * 612.0 * (bw * k) / bw * 100.0 + 0.5) / 100.0 as nx, floor(top * 792.0 * (bh * k) / bh * 100.0 + 0.5) / 100.0 as ny, floor(bw * k * 100.0 + 0.5) / 100.0 as nw, floor(bh * k * 100.0 + 0.5) / 100.0 as nh from k""",
    "scanned_pages": f"""with {_ONE}, {_BOX}, w as (select doc_id, page, sum(len(string_split(text, ' '))) as words from p group by all), ar as (select doc_id, page, sum(case when len(bbox) = 4 then greatest(0, bbox[3] - bbox[1]) * greatest(0, bbox[4] - bbox[2]) else 0 end) as area from image_box group by all)
  select doc_id, page, coalesce(words, 0) < 25 and coalesce(area / (612.0 * 792.0), 0) > 0.45 as scanned from w full outer join ar using (doc_id, page)""",
    "figures_in_questions": SECTIONS + _REG + f""", {_BOX} select exercise || '-' || question as sel_id, reg.doc_id, reg.page, name from reg join bx on bx.doc_id = reg.doc_id and bx.page = reg.page
  where (bx.ax + bx.bx) / 2 between reg.x0 and reg.x1 and (bx.ay + bx.by_) / 2 between reg.top and reg.bottom""",
    "recognised": f"""with {_BOX}, k as (select *, regexp_extract(name, 'eq(\\d+)', 1)::int + doc_id as k from bx),
  f as (select doc_id || '/' || name as name, bx - ax as w, by_ - ay as h, k, case when k % 7 = 0 then 'figure' when k % 11 = 0 then 'scan' when bx - ax < 100 and (k % 10) / 10.0 >= 0.7 then 'glyph' else 'model' end as source from k),
  r as (select *, case when source = 'glyph' then 'x' when source = 'model' and k % 5 <> 0 then 'y_' || k end as latex from f)
  select name, source, latex, source = 'scan' or (source = 'model' and (w < 100 or h > 250 or latex is null)) as needs_review from r""",
    "export_records": SECTIONS + _REG + f""", pg as (select doc_id, exercise, question, min(page) as page from reg group by all),
  st as (select *, trim(regexp_replace(regexp_replace(regexp_replace(question_text, '\\[\\[eq:([^\\]]+)\\]\\]', '![](images/\\1)', 'g'), '[ \\t]*!\\[\\]\\([^)\\s]*\\)[ \\t]*', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g')) as qs,
    trim(regexp_replace(regexp_replace(regexp_replace(solution_text, '\\[\\[eq:([^\\]]+)\\]\\]', '![](images/\\1)', 'g'), '[ \\t]*!\\[\\]\\([^)\\s]*\\)[ \\t]*', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g')) as ss,
    list_distinct(regexp_extract_all(question_text || ' ' || solution_text, '\\[\\[eq:([^\\]]+)\\]\\]', 1)) as names, list_distinct(list_concat(list_transform(regexp_extract_all(question_text, '\\[\\[eq:([^\\]]+)\\]\\]', 1), lambda x: 'q' || x), list_transform(regexp_extract_all(solution_text, '\\[\\[eq:([^\\]]+)\\]\\]', 1), lambda x: 's' || x))) as uses from sec),
  cr as (select doc_id, exercise, question, count(*) as n from (select doc_id, exercise, question, unnest(uses) as u from st) x semi join (select doc_id, name from image_box where len(bbox) = 4) ib on ib.doc_id = x.doc_id and ib.name = substr(x.u, 2) group by all),
  fx as (select *, regexp_replace(regexp_replace(regexp_replace(qs, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as q2, regexp_replace(regexp_replace(regexp_replace(ss, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as s2 from st)
  select substr(sha256(fx.doc_id || chr(31) || fx.exercise || '-' || fx.question), 1, 24) as id, number as "questionNumber", q2 as stem, case when heading = 'answer' and solution_text <> '' then s2 else '' end as answer, case when heading is distinct from 'answer' and solution_text <> '' then s2 end as explanation,
  case when title <> 'UNKNOWN' then title end as "sectionName", solution_text = '' as flagged, len(names)::int as n_images, coalesce(cr.n, 0)::int as n_crops, pg.page from fx left join cr using (doc_id, exercise, question) left join pg using (doc_id, exercise, question)""",
    "audited_questions": SECTIONS
    + """, fo as (select doc_id, page_start as page, number, number::varchar as label, question as pos from sec where number is not null), kn as (select distinct doc_id, page_start as page, label from sec where heading = 'answer')
  select doc_id, page, number, label from (select *, row_number() over (partition by doc_id, page, label order by pos) as r from fo anti join kn using (doc_id, page, label)) where r = 1""",
}


def _drawings_sql(rounds: int = 8) -> str:
    """Clusters of boxes by least labels, outlines made anew every round."""
    out = "with d0 as materialized (select row_number() over () as id, doc_id, page, bbox[1] as x0, bbox[2] as y0, bbox[3] as x1, bbox[4] as y1 from image_box where len(bbox) = 4 and not list_contains(list_transform(bbox, lambda v: v is null), true)), l0 as materialized (select id, id as g from d0)"
    for r in range(rounds):
        out += f""", o{r} as materialized (select doc_id, page, g, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from d0 join l{r} using (id) group by all),
  m{r} as materialized (select a.g, min(b.g) as h from o{r} a join o{r} b on a.doc_id = b.doc_id and a.page = b.page and a.x0 <= b.x1 + 9 and b.x0 <= a.x1 + 9 and a.y0 <= b.y1 + 9 and b.y0 <= a.y1 + 9 group by a.g), l{r + 1} as materialized (select id, h as g from l{r} join m{r} using (g))"""
    return out + f""", c as (select doc_id, page, g, count(*) as n, min(x0) as x0, min(y0) as top, max(x1) as x1, max(y1) as bottom from d0 join l{rounds} using (id) group by all)
  select doc_id, page, (row_number() over (partition by doc_id, page order by top, x0) - 1)::int as cluster, n::int as n, x0, top, x1, bottom from c"""


SQL["drawings"] = _drawings_sql()
