"""Queries over parts of questions and pages, their pictures, readings and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import images, parts, review, selections, structure
from quillmark.operators import rollups as R
from quillmark.plans import pages
from quillmark.runtime import table, written

READINGS = "map<string,struct<latex:string,source:string,needs_review:boolean>>"


def _sections(s, d):
    return structure.sections(pages._lines(s, d))


def _pages(s, d):
    """Every page as a part: its lines and the tokens of its pictures."""
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    t = t.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    b = table(s, d, "image_box").groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(parts.token("name"))), " ").alias("b"))
    j = t.join(b, ["doc_id", "page"], "full_outer")
    p = j.select("doc_id", F.col("page").cast("string").alias("key"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("label"), F.col("page").alias("page_start"), F.lit("question").alias("part"), F.concat_ws("\n", "t", "b").alias("text"))
    return p.withColumn("equations", X.image_names("text"))


def _k(name="name"):
    """A number of a picture, from its own number and its document."""
    return F.regexp_extract(name, r"eq(\d+)", 1).cast("int") + F.col("doc_id")


def _readings(p):
    h = parts.holding(p).withColumn("k", _k())
    source = F.element_at(F.array(*map(F.lit, ("glyph", "model", "figure", "skipped"))), F.pmod("k", F.lit(4)).cast("int") + 1)
    return h.select("doc_id", "key", "part", "name", F.when(F.col("k") % 3 != 0, F.concat(F.lit("x_"), F.col("k").cast("string"))).alias("latex"), source.alias("source"), (F.col("k") % 5 == 0).alias("needs_review"))


def _with_readings(s, d):
    p = _pages(s, d)
    m = _readings(p).groupBy("doc_id", "key", "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("latex", "source", "needs_review"))))).alias("readings"))
    return p.join(m, ["doc_id", "key", "part"], "left").withColumn("readings", F.coalesce("readings", F.create_map().cast(READINGS)))


def _asked(s, d, n, rest=0):
    return table(s, d, "image_box").where(_k() % n == rest).select("doc_id", "name").distinct()


def question_parts(s, d):
    return parts.parts_of(_sections(s, d)).select("doc_id", "key", "part", "label", "page_start", "text", F.size("equations").alias("pictures"))


def image_holders(s, d):
    return parts.holding(_pages(s, d))


def remaining_images(s, d):
    p = _with_readings(s, d)
    return p.select("doc_id", "key", F.array_join(images.remaining_images("equations", F.col("readings")), ",").alias("names")).where("names <> ''")


def flagged_parts(s, d):
    return _with_readings(s, d).select("doc_id", "key", review.flagged(F.col("readings"), F.col("text")).alias("flagged"))


def filled_texts(s, d):
    return _with_readings(s, d).select("doc_id", "key", X.fill_readings("text", "readings").alias("text"))


def embedded_additional(s, d):
    return parts.embedded_additional(_pages(s, d))


def _scan_names(s, d):
    """Pictures, every fifth page's named as the scan reader does."""
    b = table(s, d, "image_box").where("name is not null")
    return b.select("doc_id", F.when(F.col("page") % 5 == 0, F.replace("name", F.lit("_eq"), F.lit("_ocr"))).otherwise(F.col("name")).alias("name"))


def _declared(s, d):
    return table(s, d, "page_line").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("page") % 7 == 0, F.col("page")))).alias("scanned_pages"))


def scanned_documents(s, d):
    n = _scan_names(s, d).groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    return parts.with_scans(_declared(s, d).join(n, "doc_id", "left"))


def pages_seen(s, d):
    from quillmark.operators import sets

    return sets.pages_seen(_declared(s, d), _scan_names(s, d)).select("doc_id", F.array_join("pages", ",").alias("pages"))


def figure_anchors(s, d):
    return parts.figure_anchors(_pages(s, d)).select("doc_id", "key", "pos", "name", "anchor", "before", "trailing")


def _deduplicated(s, d):
    p = _pages(s, d)
    return parts.deduplicated(p, _readings(p), images.aliases(table(s, d, "image_box")))


def deduplicated_parts(s, d):
    return _deduplicated(s, d)[0].select("doc_id", "key", "text", F.array_join("equations", ",").alias("names"))


def deduplicated_readings(s, d):
    return _deduplicated(s, d)[1].select("doc_id", "key", "name", "latex")


def alias_map(s, d):
    return _deduplicated(s, d)[2]


def rewritten_overrides(s, d):
    p = _pages(s, d).select(F.concat_ws("/", "doc_id", "key").alias("key"), "text", "doc_id")
    a = images.aliases(table(s, d, "image_box")).select(F.concat_ws("/", "doc_id", "name").alias("name"), F.concat_ws("/", "doc_id", "alias_of").alias("alias_of"))
    own = p.select("key", F.regexp_replace("text", F.lit(r"\[\[eq:"), F.concat(F.lit("[[eq:"), F.col("doc_id").cast("string"), F.lit("/"))).alias("text"))
    return images.rewritten_refs(own, a)


def removed_images(s, d):
    p = _pages(s, d)
    return parts.removed(p, _readings(p), _asked(s, d, 4))[0].select("doc_id", "key", "text", F.array_join("equations", ",").alias("names"))


def removed_log(s, d):
    p = _pages(s, d)
    return parts.removed(p, _readings(p), _asked(s, d, 4))[2]


def remaining_readings(s, d):
    p = _pages(s, d)
    return parts.removed(p, _readings(p), _asked(s, d, 4))[1].select("doc_id", "key", "name", "source")


def deleted_tokens(s, d):
    return images.without_images(_pages(s, d).select("doc_id", "key", "text"), _asked(s, d, 6))


def reclassified_readings(s, d):
    f = table(s, d, "image_box").select("doc_id", "name", F.when(_k() % 7 == 0, "coloured").alias("reason"))
    return parts.reclassified(_readings(_pages(s, d)), f).select("doc_id", "key", "name", "latex", "source", "needs_review")


def carried_readings(s, d):
    """Pages split anew (their keys change, every third is not found): readings stay with the pictures."""
    p = _pages(s, d)
    fresh = p.where("page_start % 3 <> 0").withColumn("key", F.concat(F.lit("n"), "key"))
    return parts.restructured(fresh, _readings(p), _asked(s, d, 9))[1].select("doc_id", "key", "name", "latex", "source")


def reviewed_results(s, d):
    r = table(s, d, "image_box").where(_k() % 4 == 1).select("doc_id", "name", F.concat(F.lit("r_"), "name").alias("latex"), F.lit("ai").alias("source")).distinct()
    return images.with_result(_readings(_pages(s, d)), r).select("doc_id", "key", "name", "latex", "source", "needs_review")


def validated_readings(s, d):
    r = _readings(_pages(s, d)).withColumn("latex", F.when(_k() % 11 == 0, F.concat("latex", F.lit("}"))).when(_k() % 13 == 0, F.concat(F.lit(r"\left( "), "latex")).otherwise(F.col("latex")))
    return images.validated(r).select("doc_id", "key", "name", "latex", "needs_review", "katex_error")


def _actions(s, d):
    b = table(s, d, "image_box").select("doc_id", "name").distinct().withColumn("k", _k()).where("k % 5 < 3")
    action = F.element_at(F.array(*map(F.lit, ("ai", "skip", "remove"))), F.pmod("k", F.lit(5)).cast("int") + 1)
    return b.select("doc_id", "name", action.alias("action"), F.when((F.col("k") % 2 == 0) & (action == "ai"), F.concat(F.lit("a_"), F.col("k").cast("string"))).alias("latex"))


def _acted(s, d):
    p = _pages(s, d)
    o = p.select("doc_id", "key", "part", F.regexp_replace("text", X.IMAGE_TOKEN, "![](img:$1)").alias("text"))
    return parts.acted(p, _readings(p), o, _actions(s, d))


def acted_parts(s, d):
    return _acted(s, d)[0].select("doc_id", "key", "text")


def acted_readings(s, d):
    return _acted(s, d)[1].select("doc_id", "key", "name", "latex", "source", "needs_review")


def acted_overrides(s, d):
    return _acted(s, d)[2].select("doc_id", "key", "text")


def acted_log(s, d):
    return _acted(s, d)[3]


def _migration(s, d):
    t = pages._lines(s, d)
    old, new = written(structure.sections(t), "old"), written(structure.sections(t.where("not text like 'ADDITIONAL%' and not text like 'Q%3%'")), "new")
    keys = old.select("doc_id", F.concat_ws("-", "exercise", "question").alias("key"))
    docs = old.select("doc_id").distinct().withColumn("version", (F.col("doc_id") % 2 + 6).cast("int"))
    edits = keys.unionByName(docs.select("doc_id", F.lit("add-1").alias("key"))).withColumn("edit", F.concat(F.lit("e"), "key"))
    return parts.migrated(docs, old, new, edits, 8)


def migrated_documents(s, d):
    return _migration(s, d)[0]


def migrated_questions(s, d):
    return _migration(s, d)[1].select("doc_id", "exercise", "question", "title", "label")


def migrated_edits(s, d):
    return _migration(s, d)[2]


def orphaned_edits(s, d):
    return _migration(s, d)[3]


# ---------------------------------------------------------------- areas drawn on pages
def _areas(s, d):
    """One area per box, in shares of the page: some too small, some outside."""
    b = table(s, d, "image_box").where("size(bbox) = 4").select("doc_id", "name", "page", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))
    k = _k()
    x1 = F.when(k % 6 == 0, F.col("x0") + 3).when(k % 13 == 0, F.lit(1000.0)).otherwise(F.col("x1"))
    return b.select("doc_id", "name", "page", k.alias("k"), F.array(F.col("x0") / 612.0, F.col("y0") / 792.0, x1 / 612.0, F.col("y1") / 792.0).alias("area"))


def _effective(s, d):
    p = _pages(s, d)
    return p.select("doc_id", "key", "part", F.when(F.col("page_start") % 4 == 0, F.concat(F.lit("edited "), "key", F.lit("  "))).alias("override"), F.col("text").alias("auto"))


def _crops(s, d):
    a = _areas(s, d)
    c = a.select("doc_id", F.when(F.col("k") % 17 == 0, "none").otherwise(F.col("page").cast("string")).alias("key"), F.lit("question").alias("part"), "page", "area", F.col("name").alias("pos"))
    return selections.cropped(c, _effective(s, d), s.createDataFrame([], "doc_id int, name string"))


def manual_crops(s, d):
    return _crops(s, d)[0].select("doc_id", "key", "name", "page", "error")


def cropped_texts(s, d):
    return _crops(s, d)[1].select("doc_id", "key", "text")


def manual_names(s, d):
    b = table(s, d, "image_box").where("name is not null").select("doc_id", F.when(_k() % 3 == 0, F.regexp_replace("name", r"^p\d+_eq", "manual_")).otherwise(F.col("name")).alias("name"))
    return images.next_manual_name(b)


def _plan(s, d):
    """A page's areas, in order of their pictures, as one request."""
    a = _areas(s, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("name", "page", "area"))).alias("a"))
    r = a.select(F.concat_ws("/", "doc_id", "page").alias("req_id"), "doc_id", F.col("page").cast("string").alias("key"), F.when(F.col("page") % 10 == 9, "answer").otherwise("question").alias("part"), F.transform("a", lambda e: F.struct(e["page"].alias("page"), e["area"].alias("area"))).alias("areas"))
    sizes = table(s, d, "image_box").where("page % 11 <> 0").select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    return selections.planned(r, sizes)


def planned_areas(s, d):
    return _plan(s, d).select("req_id", "error", F.size("areas").alias("areas"))


def selected_figures(s, d):
    f = table(s, d, "image_box").select("doc_id", "name", "page", "bbox", F.col("name").alias("pos"))
    return selections.figures_selected(_plan(s, d), f).select("req_id", F.array_join("figures", ",").alias("figures"))


def extracted_parts(s, d):
    """Answers of a reader: every third request reads nothing, every sixth of a blank area."""
    p = written(_plan(s, d), "plan")
    n = F.conv(F.substring(F.md5("req_id"), 1, 6), 16, 10).cast("int")
    a = p.select("req_id", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(" read $x_"), n.cast("string"), F.lit("$ "))).alias("question"), F.when(n % 2 == 0, "and then").alias("solution"), F.when((n % 6 == 0) | (n % 6 == 3), F.when(n % 12 < 6, 0).otherwise(5000)).otherwise(900).alias("dark"), F.lit(100_000).alias("pixels"))
    a = a.withColumn("solution", F.when(F.col("question") != "", F.col("solution")))
    t = _effective(s, d).select("doc_id", "key", "part", F.coalesce("override", "auto").alias("text"))
    none = s.createDataFrame([], "req_id string, figures array<string>")
    return selections.extracted(p, a, t, none, s.createDataFrame([], "doc_id int, name string")).select("req_id", "text", F.array_join("new_names", ",").alias("new_names"), "error")


def pictures_read(s, d):
    """Each picture's reference replaced by what was read of it, where nothing speaks against it."""
    t = _pages(s, d).select("doc_id", "key", "part", F.regexp_replace("text", X.IMAGE_TOKEN, "![](img:$1)").alias("text"))
    a = _areas(s, d).withColumn("key", F.col("page").cast("string"))
    r = a.join(t.select("doc_id", "key", "part", F.col("text").alias("seen0")), ["doc_id", "key"])
    r = r.select(F.concat_ws("/", "doc_id", "name").alias("req_id"), "doc_id", "key", "part", F.when(F.col("k") % 19 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), "area", F.when(F.col("k") % 8 == 0, F.concat("seen0", F.lit("!"))).otherwise(F.col("seen0")).alias("seen"), "k")
    said = F.when(F.col("k") % 9 == 0, "").when(F.col("k") % 10 == 0, "[[FIGURE]]").otherwise(F.concat(F.lit("read $"), F.col("k").cast("string"), F.lit("$")))
    answers = r.select("req_id", said.alias("question"), F.lit("").alias("solution"), F.when(F.col("k") % 7 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("faults"))
    return selections.picture_read(r.drop("k"), t, answers).select("req_id", "text", "error")


def added_questions(s, d):
    """A question drawn on every page that has a box."""
    a = _areas(s, d).groupBy("doc_id", "page").agg(F.min_by(F.struct("name", "area", "k"), "name").alias("r"))
    drawn = a.select(F.concat_ws("-", F.col("page").cast("string"), "r.name").alias("id"), "doc_id", "page", "r.area", F.when(F.col("r.k") % 2 == 0, F.concat(F.lit("[[FIGURE]] what is $"), F.col("r.k").cast("string"), F.lit("$ "))).alias("stem"), F.lit("one [[FIGURE]] two").alias("solution"))
    t = pages._lines(s, d)
    return selections.added_questions(drawn, structure.sections(t), t).select("doc_id", "key", "page", "exercise", "number", "stem", "solution", "figures_seen", "error")


def placed_figures(s, d):
    """Rewritten pages (their lines in capitals) with their pictures put back."""
    p = _pages(s, d).withColumn("original", F.regexp_replace("text", X.IMAGE_TOKEN, "![](img:$1)"))
    p = p.withColumn("ai", F.upper(F.regexp_replace("text", X.IMAGE_TOKEN, ""))).withColumn("figures", F.col("equations"))
    return review.place_figures(p, "ai", "original", "figures").select("doc_id", "key", "placed")


def reread_parts(s, d):
    """Questions of the splitter read anew in capitals, every third with a fault; every second was edited before."""
    p = parts.parts_of(_sections(s, d))
    edited = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int") % 2 == 0
    p = p.withColumn("override", F.when(edited & (F.col("part") == "question"), F.lit("edited")))
    a = p.groupBy("doc_id", "key").agg(F.upper(F.max(F.when(F.col("part") == "question", F.regexp_replace("text", X.IMAGE_TOKEN, "")))).alias("question"), F.lit("read $x$").alias("solution"), F.max(F.when(F.length("text") % 3 == 0, F.array(F.lit("fault")))).alias("faults"))
    return selections.reread(p, _readings(p), a).select("doc_id", "key", "part", "text", "warned")


def repair_faults(s, d):
    """Why a page's rewriting cannot replace it."""
    p = _pages(s, d)
    original = F.regexp_replace("text", X.IMAGE_TOKEN, "![](img:$1)")
    k = F.col("page_start") + F.col("doc_id")
    new = F.when(k % 7 == 0, F.lit("  ")).when(k % 7 == 1, F.concat("original", F.lit("\x07"))).when(k % 7 == 2, F.concat("original", F.lit(" ![](img:new.png)"))).when(k % 7 == 3, F.concat("original", F.lit(r" \(x"))).when(k % 7 == 4, F.concat("original", F.lit(" a_b"))).otherwise(F.col("original"))
    return p.withColumn("original", original).withColumn("rewritten", new).select("doc_id", "key", review.repair_fault().alias("fault"))


QUERIES = {f.__name__: f for f in (question_parts, image_holders, remaining_images, flagged_parts, filled_texts, embedded_additional, scanned_documents, pages_seen, figure_anchors, deduplicated_parts, deduplicated_readings, alias_map, rewritten_overrides, removed_images, removed_log, remaining_readings, deleted_tokens, reclassified_readings, carried_readings, reviewed_results, validated_readings, acted_parts, acted_readings, acted_overrides, acted_log, migrated_documents, migrated_questions, migrated_edits, orphaned_edits, manual_crops, cropped_texts, manual_names, planned_areas, selected_figures, extracted_parts, pictures_read, added_questions, placed_figures, reread_parts, repair_faults)}

_TOK = r"\[\[eq:([^\]]+)\]\]"
_NUM = "regexp_extract({}, 'eq(\\d+)', 1)::int + doc_id"
#: Pages as parts: pt(doc_id, key, page, text, eqs), their pictures hd(doc_id, key, name, k) and readings rd.
PAGES = (
    "with "
    + pages._ONE
    + rf""", pgt as (select doc_id, page, string_agg(text, chr(10) order by line_no) as t from p group by all), bxt as (select doc_id, page, string_agg('[[eq:' || name || ']]', ' ' order by name) as b from image_box group by all),
  pt as (select doc_id, page, page::varchar as key, concat_ws(chr(10), t, b) as text, regexp_extract_all(concat_ws(chr(10), t, b), '{_TOK}', 1) as eqs from pgt full outer join bxt using (doc_id, page)),
  hd as (select *, {_NUM.format("name")} as k from (select distinct doc_id, key, page, unnest(eqs) as name from pt)),
  rd as (select *, case when k % 3 <> 0 then 'x_' || k end as latex, ['glyph', 'model', 'figure', 'skipped'][k % 4 + 1] as source, k % 5 = 0 as needs_review from hd)
"""
)
_RX = "regexp_replace(text, '" + _TOK + "', '![](img:\\1)', 'g')"


def _alias_sql(levels: int = 4) -> str:
    """Greedy aliases al(doc_id, page, name, alias_of), a level of decided boxes after the other. A box is kept when no
    earlier near one is kept; chains longer than the levels do not occur in near-identical boxes of one page."""
    out = "nb as (" + pages.SQL["near_boxes"] + "), open0 as (select distinct doc_id, page, name_b as name from nb), kept0 as (select distinct doc_id, page, name_a as name from nb anti join open0 on open0.doc_id = nb.doc_id and open0.page = nb.page and open0.name = nb.name_a)"
    for n in range(levels):
        out += f""", gone{n} as (select distinct o.doc_id, o.page, o.name from open{n} o join nb on nb.doc_id = o.doc_id and nb.page = o.page and nb.name_b = o.name join kept{n} k on k.doc_id = nb.doc_id and k.page = nb.page and k.name = nb.name_a),
  rest{n} as (select * from open{n} except select * from gone{n}), kept{n + 1} as (select r.doc_id, r.page, r.name from rest{n} r where not exists (select 1 from nb join rest{n} e on e.doc_id = nb.doc_id and e.page = nb.page and e.name = nb.name_a where nb.doc_id = r.doc_id and nb.page = r.page and nb.name_b = r.name)),
  open{n + 1} as (select * from rest{n} except select * from kept{n + 1})"""
    kept = " union ".join(f"select * from kept{n}" for n in range(levels + 1))
    return out + f", kept as ({kept}), al as (select nb.doc_id, nb.page, nb.name_b as name, min(nb.name_a) as alias_of from nb join kept k on k.doc_id = nb.doc_id and k.page = nb.page and k.name = nb.name_a anti join kept q on q.doc_id = nb.doc_id and q.page = nb.page and q.name = nb.name_b group by all)"


ALIAS = _alias_sql()
#: Aliases that leave a page: gone(doc_id, key, name, alias_of).
_GONE = PAGES + ", " + ALIAS + ", gone as (select h.doc_id, h.key, h.name, al.alias_of from hd h join al on al.doc_id = h.doc_id and al.name = h.name join pt on pt.doc_id = h.doc_id and pt.key = h.key where list_contains(pt.eqs, al.alias_of)), gn as (select doc_id, key, list(name order by name) as gs from gone group by all)"
_CUT = "list_reduce(list_prepend(text, coalesce(gs, [])), lambda a, n: replace(a, '[[eq:' || n || ']]', ''))"
_LESS = "array_to_string(list_filter(list_distinct_in_order, lambda n: not list_contains(coalesce(gs, []), n)), ',')".replace("list_distinct_in_order", "list_filter(eqs, lambda n, i: list_position(eqs, n) = i)")
_SQUEEZE = "case when gs is null then text else regexp_replace(regexp_replace(" + _CUT + ", '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end"
_DROP4 = PAGES + f", ask as (select distinct doc_id, name from image_box where ({_NUM.format('name')}) % 4 = 0), gone as (select h.* from hd h semi join ask using (doc_id, name)), gn as (select doc_id, key, list(name order by name) as gs from gone group by all)"
_ACT = PAGES + f""", ac0 as (select distinct doc_id, name, {_NUM.format("name")} as k from image_box), ac as (select doc_id, name, k, ['ai', 'skip', 'remove'][k % 5 + 1] as action, case when k % 2 = 0 and k % 5 = 0 then 'a_' || k end as latex from ac0 where k % 5 < 3), act as (select h.doc_id, h.key, h.name, ac.action, ac.latex from hd h join ac on ac.doc_id = h.doc_id and ac.name = h.name)"""
_AREA = f"""ar0 as (select doc_id, name, page, {_NUM.format("name")} as k, bbox[1] as x0, bbox[2] as y0, bbox[3] as x1, bbox[4] as y1 from image_box where len(bbox) = 4),
  ar as (select doc_id, name, page, k, [x0 / 612.0, y0 / 792.0, case when k % 6 = 0 then x0 + 3 when k % 13 = 0 then 1000.0 else x1 end / 612.0, y1 / 792.0] as area from ar0),
  box as (select *, len(list_filter(area, lambda v: v is null or v < 0 or v > 1)) = 0 as ok from ar),
  pts as (select *, floor(greatest(area[1], area[3]) * 612.0 * 10.0 + 0.5) / 10.0 - floor(least(area[1], area[3]) * 612.0 * 10.0 + 0.5) / 10.0 as bw, floor(greatest(area[2], area[4]) * 792.0 * 10.0 + 0.5) / 10.0 - floor(least(area[2], area[4]) * 792.0 * 10.0 + 0.5) / 10.0 as bh from box)"""
_EFF = "ef as (select doc_id, key, page, case when page % 4 = 0 then 'edited ' || key || '  ' else text end as text from pt)"
_CROP = PAGES + ", " + _AREA + ", " + _EFF + """, cr as (select p.doc_id, case when k % 17 = 0 then 'none' else p.page::varchar end as key, p.page, name as pos, ok, bw, bh from pts p),
  ce as (select cr.*, case when ef.key is null then 'unknown question' when not ok then 'not an area' when bw < 5 or bh < 5 then 'too small' end as error from cr left join ef on ef.doc_id = cr.doc_id and ef.key = cr.key),
  cn as (select *, 'manual_' || lpad((row_number() over (partition by doc_id order by pos, key))::varchar, 3, '0') || '.png' as name, row_number() over (partition by doc_id order by pos, key) as n from ce where error is null)"""
_PLAN = PAGES + ", " + _AREA + """, pl0 as (select *, row_number() over (partition by doc_id, page order by name) - 1 as n, case when page % 11 = 0 then 'no such page' when not ok then 'not an area' when bw < 5 or bh < 5 then 'too small' end as fault from pts),
  pl as (select doc_id || '/' || page as req_id, doc_id, page, page::varchar as key, case when page % 10 = 9 then 'choose question or solution' when count(*) > 8 then 'too many areas' else arg_min(fault, n) filter (fault is not null) end as error, count(*)::int as areas from pl0 group by doc_id, page)"""


def _migration_sql() -> str:
    """Four passes of matching old sections to new ones, and what becomes of edits."""
    second = pages.SECTIONS.replace("from page_line where text is not null", "from page_line where text is not null and not text like 'ADDITIONAL%' and not text like 'Q%3%'")
    sig = "doc_id, exercise, question, exercise || '-' || question as key, title, upper(label) as label, coalesce(page_start, -1) as page, substr(trim(regexp_replace(coalesce(question_text, ''), '\\s+', ' ', 'g')), 1, 160) as stem, question_text, solution_text"
    out = f"with o0 as (select {sig}, label as shown from ({pages.SECTIONS} select * from sec)), n0 as (select {sig}, label as shown from ({second} select * from sec))"
    passes = (("label", "page", "stem"), ("label", "page"), ("title", "label", "stem"), ("title", "label"))
    for i, cols in enumerate(passes):
        g = ", ".join(("doc_id", *cols))
        out += f""", m{i} as (select * from (select {g}, arg_min(key, (exercise, question)) as old_key from o{i} group by {g}) join (select {g}, min(key) as new_key from n{i} group by {g} having count(*) = 1) using ({g})),
  o{i + 1} as (select * from o{i} where (doc_id, key) not in (select (doc_id, old_key) from m{i})), n{i + 1} as (select * from n{i} where (doc_id, key) not in (select (doc_id, new_key) from m{i}))"""
    out += ", mp as (" + " union all ".join(f"select doc_id, old_key, new_key from m{i}" for i in range(4)) + ")"
    return out + """, em as (select doc_id, bool_or(regexp_matches(t, '(?im)^\\s*Additional Exercises\\s*$') or regexp_matches(t, '(?im)^\\s*Question\\s+A\\d+\\s*:')) as embedded from (select doc_id, unnest([question_text, solution_text]) as t from o0) group by 1),
  dc as (select doc_id, doc_id % 2 + 6 as version, embedded, (doc_id % 2 + 6) < 8 and not ((doc_id % 2 + 6) = 7 and not embedded) as behind from em),
  ed as (select doc_id, key, 'e' || key as edit from (select doc_id, key from o0 union all select distinct doc_id, 'add-1' from o0))"""


MIGRATION = _migration_sql()

SQL = {
    "question_parts": pages.SECTIONS + rf", pt as (select *, unnest(['question', 'solution']) as part from sec) select doc_id, exercise || '-' || question as key, part, label, page_start, case when part = 'question' then question_text else solution_text end as text, len(regexp_extract_all(case when part = 'question' then question_text else solution_text end, '{_TOK}'))::int as pictures from pt",
    "image_holders": PAGES + "select doc_id, name, key, 'question' as part from hd",
    "remaining_images": PAGES + "select doc_id, key, array_to_string(list_filter(list_filter(eqs, lambda n, i: list_position(eqs, n) = i), lambda n: " + _NUM.format("n").replace("::int", "::int") + " is not null and ((" + _NUM.format("n") + ") % 4 = 2 or (" + _NUM.format("n") + ") % 5 = 0 or (" + _NUM.format("n") + ") % 3 = 0)), ',') as names from pt where names <> ''",
    "flagged_parts": PAGES + "select doc_id, key, len(list_filter(eqs, lambda n: (" + _NUM.format("n") + ") % 5 = 0)) > 0 or text = '' as flagged from pt",
    "filled_texts": PAGES + r", rp as (select doc_id, key, list('[[eq:' || name || ']]' || chr(1) || '\(' || latex || '\)' order by name) as rs from rd where latex is not null and not needs_review group by all) select doc_id, key, regexp_replace(list_reduce(list_prepend(text, coalesce(rs, [])), lambda a, r: replace(a, split_part(r, chr(1), 1), split_part(r, chr(1), 2))), '[ \t]{2,}', ' ', 'g') as text from pt left join rp using (doc_id, key)",
    "embedded_additional": PAGES + r"select doc_id, bool_or(regexp_matches(text, '(?im)^\s*Additional Exercises\s*$') or regexp_matches(text, '(?im)^\s*Question\s+A\d+\s*:')) as embedded from pt group by doc_id",
    "scanned_documents": "with dl as (select doc_id, count(*) filter (page % 7 = 0) as n from page_line group by 1), oc as (select doc_id, count(*) filter (page % 5 = 0) as m from image_box where name is not null group by 1) select doc_id, n > 0 or coalesce(m, 0) > 0 as scanned from dl left join oc using (doc_id)",
    "pages_seen": "with dl as (select doc_id, list(distinct page) filter (page % 7 = 0) as a from page_line group by 1), oc as (select doc_id, list(distinct regexp_extract(name, '^p(\\d+)_', 1)::int) filter (page % 5 = 0) as b from image_box where name is not null group by 1) select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ','), '') as pages from dl left join oc using (doc_id)",
    "figure_anchors": PAGES + rf", sp as (select doc_id, key, eqs, list_transform(regexp_split_to_array(text, '\[\[eq:[^\]]+\]\]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as ps from pt), e as (select *, unnest(range(len(eqs))) as i from sp), f as (select *, list_filter(ps[1 : i + 1], lambda x: x <> '') as a, list_filter(ps[i + 2 :], lambda x: x <> '') as z from e) select doc_id, key, i::int as pos, eqs[i + 1] as name, a[-1] as anchor, len(a)::int as before, len(z) = 0 as trailing from f",
    "deduplicated_parts": _GONE + f"select doc_id, key, {_CUT} as text, {_LESS} as names from pt left join gn using (doc_id, key)",
    "deduplicated_readings": _GONE + "select doc_id, key, name, latex from rd anti join gone using (doc_id, key, name)",
    "alias_map": _GONE + "select distinct doc_id, name, alias_of from gone",
    "rewritten_overrides": PAGES + ", " + ALIAS + ", pr as (select h.doc_id, h.key, list('[[eq:' || h.doc_id || '/' || h.name || ']]' || chr(1) || '[[eq:' || h.doc_id || '/' || al.alias_of || ']]' order by h.doc_id || '/' || h.name) as rs from hd h join al on al.doc_id = h.doc_id and al.name = h.name group by all), ov as (select doc_id, key, replace(text, '[[eq:', '[[eq:' || doc_id || '/') as text from pt) select doc_id || '/' || key as key, list_reduce(list_prepend(text, coalesce(rs, [])), lambda a, r: replace(a, split_part(r, chr(1), 1), case when contains(a, split_part(r, chr(1), 2)) then '' else split_part(r, chr(1), 2) end)) as text from ov left join pr using (doc_id, key)",
    "removed_images": _DROP4 + f"select doc_id, key, {_SQUEEZE} as text, {_LESS} as names from pt left join gn using (doc_id, key)",
    "removed_log": _DROP4 + "select doc_id, name, count(*) as occurrences from gone group by all",
    "remaining_readings": _DROP4 + "select doc_id, key, name, source from rd anti join gone using (doc_id, key, name)",
    "deleted_tokens": _DROP4.replace("% 4 = 0", "% 6 = 0") + f"select doc_id, key, {_SQUEEZE} as text, coalesce(len(gs), 0)::int as removed from pt left join gn using (doc_id, key)",
    "reclassified_readings": PAGES + "select doc_id, key, name, case when not hit then latex end as latex, case when hit then 'figure' else source end as source, case when hit then false else needs_review end as needs_review from (select *, k % 7 = 0 and source not in ('figure', 'skipped') and (doc_id, name) in (select (doc_id, name) from image_box) as hit from rd)",
    "carried_readings": PAGES + f", ask as (select distinct doc_id, name from image_box where ({_NUM.format('name')}) % 9 = 0) select doc_id, 'n' || key as key, name, latex, source from rd anti join ask using (doc_id, name) where page % 3 <> 0",
    "reviewed_results": PAGES + "select doc_id, key, name, case when hit then 'r_' || name else latex end as latex, case when hit then 'ai' else source end as source, case when hit then false else needs_review end as needs_review from (select *, k % 4 = 1 and (doc_id, name) in (select (doc_id, name) from image_box) as hit from rd)",
    "validated_readings": PAGES + r", v as (select *, case when k % 11 = 0 then latex || '}' when k % 13 = 0 then '\left( ' || latex else latex end as l from rd), w as (select *, case when l is null or needs_review then null when k % 11 = 0 then 'unbalanced braces' when k % 13 = 0 then 'unbalanced \left and \right' end as e from v) select doc_id, key, name, l as latex, needs_review or e is not null as needs_review, e as katex_error from w",
    "acted_parts": _ACT + f", gn as (select doc_id, key, list(name order by name) as gs from act where action = 'remove' group by all) select doc_id, key, {_SQUEEZE} as text from pt left join gn using (doc_id, key)",
    "acted_readings": _ACT + ", nr as (select doc_id, key, name, case when action = 'ai' then latex end as latex, case when action = 'skip' then 'skipped' when latex is null then 'figure' else 'ai' end as source, false as needs_review from act where action <> 'remove') select doc_id, key, name, latex, source, needs_review from rd anti join act using (doc_id, key, name) union all select * from nr",
    "acted_overrides": _ACT + rf", sw as (select doc_id, key, list('![](img:' || name || ')' || chr(1) || case when action = 'ai' then '\(' || latex || '\)' else '' end order by name) as rs from act where action = 'remove' or (action = 'ai' and latex is not null) group by all), ov as (select doc_id, key, {_RX} as text from pt) select doc_id, key, case when rs is null then text else regexp_replace(list_reduce(list_prepend(text, rs), lambda a, r: replace(a, split_part(r, chr(1), 1), split_part(r, chr(1), 2))), '^\s+|\s+$', '', 'g') end as text from ov left join sw using (doc_id, key)",
    "acted_log": _ACT + "select doc_id, name, action, count(*) as occurrences from act group by all",
    "migrated_documents": MIGRATION + "select doc_id, 8 as version, behind as split_again from dc",
    "migrated_questions": MIGRATION + "select doc_id, exercise, question, title, shown as label from o0 semi join (select * from dc where not behind) using (doc_id) union all select doc_id, exercise, question, title, shown from n0 semi join (select * from dc where behind) using (doc_id)",
    "migrated_edits": MIGRATION + "select doc_id, case when behind and key not like 'add-%' then new_key else key end as key, edit from ed join dc using (doc_id) left join mp on mp.doc_id = ed.doc_id and mp.old_key = ed.key where not behind or key like 'add-%' or new_key is not null",
    "orphaned_edits": MIGRATION + "select ed.doc_id, o0.title || '|' || shown || '|' || ed.key as orphan, edit from ed join dc using (doc_id) left join mp on mp.doc_id = ed.doc_id and mp.old_key = ed.key left join o0 on o0.doc_id = ed.doc_id and o0.key = ed.key where behind and ed.key not like 'add-%' and new_key is null",
    "manual_crops": _CROP + "select doc_id, key, name, page, error from cn union all select doc_id, key, null, page, error from ce where error is not null",
    "cropped_texts": _CROP + r", nw as (select doc_id, key, string_agg('![](img:' || name || ')', chr(10) order by n) as l from cn group by all) select doc_id, key, regexp_replace(regexp_replace(text, '\s+$', '') || chr(10) || l, '^\s+|\s+$', '', 'g') as text from ef join nw using (doc_id, key)",
    "manual_names": f"with b as (select doc_id, case when ({_NUM.format('name')}) % 3 = 0 then regexp_replace(name, '^p\\d+_eq', 'manual_') else name end as name from image_box where name is not null) select doc_id, 'manual_' || lpad((coalesce(max(try_cast(nullif(regexp_extract(name, '^manual_(\\d+)', 1), '') as int)), -1) + 1)::varchar, 3, '0') || '.png' as name from b group by doc_id",
    "planned_areas": _PLAN + "select req_id, error, areas from pl",
    "selected_figures": _PLAN + f", {pages._BOX}, rp as (select doc_id || '/' || page as req_id, doc_id, page, floor(least(area[1], area[3]) * 612.0 * 10.0 + 0.5) / 10.0 as x0, floor(least(area[2], area[4]) * 792.0 * 10.0 + 0.5) / 10.0 as y0, floor(greatest(area[1], area[3]) * 612.0 * 10.0 + 0.5) / 10.0 as x1, floor(greatest(area[2], area[4]) * 792.0 * 10.0 + 0.5) / 10.0 as y1 from pl0), hit as (select distinct rp.req_id, bx.name from rp semi join (select * from pl where error is null) g on g.req_id = rp.req_id join bx on bx.doc_id = rp.doc_id and bx.page = rp.page where (bx.ax + bx.bx) / 2 between rp.x0 and rp.x1 and (bx.ay + bx.by_) / 2 between rp.y0 and rp.y1) select req_id, string_agg(name, ',' order by name) as figures from hit group by req_id",
    "extracted_parts": _PLAN + ", " + _EFF + r""", an as (select pl.*, ef.text as original, ('0x' || substr(md5(req_id), 1, 6))::int as n from pl left join ef on ef.doc_id = pl.doc_id and ef.key = pl.key),
  st as (select *, case when error is not null then error when original is null then 'unknown question' when n % 3 = 0 and n % 12 < 6 then 'the area is blank' end as fault from an), wt as (select *, case when fault is null and n % 3 = 0 then areas else 0 end as want from st),
  nm as (select *, coalesce(sum(want) over (partition by doc_id order by req_id rows between unbounded preceding and 1 preceding), 0)::int as from_ from wt), ns as (select *, list_transform(range(1, want + 1), lambda i: 'manual_' || lpad((from_ + i)::varchar, 3, '0') || '.png') as names from nm)
  select req_id, case when fault is not null then null when n % 3 = 0 then array_to_string(list_transform(names, lambda x: '![](img:' || x || ')'), chr(10)) else 'read \(x_' || n || '\)' || case when n % 2 = 0 then chr(10) || 'and then' else '' end end as text, coalesce(array_to_string(names, ','), '') as new_names, fault as error from ns""",
    "pictures_read": PAGES + ", " + _AREA + rf""", tx as (select doc_id, key, page, {_RX} as text from pt), rq as (select p.doc_id || '/' || p.name as req_id, p.doc_id, p.page, k, ok, area, case when k % 19 = 0 then p.name || 'x' else p.name end as name, text, case when k % 8 = 0 then text || '!' else text end as seen from pts p join tx on tx.doc_id = p.doc_id and tx.page = p.page),
  er as (select *, '![](img:' || name || ')' as ref, case when k % 19 = 0 then 'not a picture' when not contains(seen, '![](img:' || name || ')') then 'the picture is no longer in the text' when not ok or area[3] - area[1] < 0.005::double or area[4] - area[2] < 0.005::double then 'not an area' when k % 9 = 0 or k % 10 = 0 then 'no text was read' when k % 7 = 0 then 'invalid maths' when k % 8 = 0 then 'the text changed meanwhile' end as error from rq)
  select req_id, case when error is null then substr(text, 1, strpos(text, ref) - 1) || 'read \(' || k || '\)' || substr(text, strpos(text, ref) + length(ref)) end as text, error from er""",
    "added_questions": pages.SECTIONS + ", " + _AREA + r""", per as (select doc_id, page_start as page, exercise, count(*) as n from sec group by all), best as (select doc_id, page, exercise from (select *, row_number() over (partition by doc_id, page order by n desc, exercise) as r from per) where r = 1),
  nx as (select doc_id, exercise, coalesce(max(number), 0) + 1 as next_number from sec group by all), last as (select doc_id, max(exercise) as last from sec group by doc_id), pg as (select distinct doc_id, page from b where page is not null),
  slot as (select pg.doc_id, pg.page, nx.exercise, nx.next_number from pg left join best using (doc_id, page) join last on last.doc_id = pg.doc_id join nx on nx.doc_id = pg.doc_id and nx.exercise = coalesce(best.exercise, last.last)),
  dr as (select *, page || '-' || name as id from (select *, row_number() over (partition by doc_id, page order by name) as r from pts) where r = 1),
  er as (select dr.doc_id, dr.page, id, k, slot.exercise, slot.next_number, case when next_number is null then 'no such page' when not ok then 'not an area' when bw < 20 or bh < 20 then 'too small' end as error from dr left join slot on slot.doc_id = dr.doc_id and slot.page = dr.page)
  select doc_id, 'add-' || id as key, page, exercise, case when error is null then (next_number + count(*) filter (error is null) over (partition by doc_id, exercise order by id) - 1)::int end as number, case when k % 2 = 0 then 'what is \(' || k || '\)' else '' end as stem, 'one two' as solution, (case when k % 2 = 0 then 2 else 1 end)::int as figures_seen, error from er""",
    "repair_faults": PAGES + r", o as (select doc_id, key, page + doc_id as k, text from pt) select doc_id, key, case when k % 7 = 0 or regexp_matches(text, '^\s*$') then 'no text' when k % 7 = 1 then 'control characters' when k % 7 = 2 then 'image reference changed' when k % 7 = 3 or len(regexp_extract_all(text, '\\\(')) <> len(regexp_extract_all(text, '\\\)')) or len(regexp_extract_all(text, '\\\[')) <> len(regexp_extract_all(text, '\\\]')) then 'unmatched delimiters' when k % 7 = 4 or regexp_matches(replace(replace(regexp_replace(text, '(?s)\[\[eq:[^\]]+\]\]|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g'), '\_', ''), '\^', ''), '[_^]') then 'script outside maths' end as fault from o",
}
pages.SQL["image_aliases"] = "with " + ALIAS + " select * from al"
pages.SQL["deduplicated_sections"] = "with " + pages._ONE + ", " + ALIAS + rf""", sc as (select doc_id, page::varchar as key, string_agg(text, chr(10) order by line_no) as text from p group by doc_id, page), hn as (select distinct doc_id, key, unnest(regexp_extract_all(text, '{_TOK}', 1)) as name from sc),
  gn as (select h.doc_id, h.key, list(h.name order by h.name) as gs from hn h join al on al.doc_id = h.doc_id and al.name = h.name join sc on sc.doc_id = h.doc_id and sc.key = h.key where contains(sc.text, '[[eq:' || al.alias_of || ']]') group by all) select doc_id, key, {_CUT} as text, coalesce(len(gs), 0)::int as dropped from sc left join gn using (doc_id, key)"""
pages.SQL["remapped"] = MIGRATION + "select doc_id, old_key, new_key from mp"
