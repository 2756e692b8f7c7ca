"""Picture boxes and readings: near-identical boxes, recognition cascade, deletions and rewrites."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions import text as X

#: Names that take part, largest shift of an edge (points), least overlap.
NAME, SHIFT, OVERLAP = r"^p\d+_eq\d+\.png$", 2.0, 0.9

READING = "struct<latex:string,source:string,kind:string,confidence:double,needs_review:boolean,reason:string>"


def usable(boxes: DataFrame) -> DataFrame:
    """Boxes that can have aliases: named like extracted pictures, four numbers, an area."""
    return boxes.where(F.col("name").rlike(NAME) & (F.size("bbox") == 4) & (G.area("bbox") > 0) & ~F.exists("bbox", lambda v: v.isNull()))


def near_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes on one page that nearly coincide, by an equi-join on page and a coarse cell of the corner.

    Cells are as wide as the largest shift and every box also stands in its next cells, so that no pair is missed and
    a crowded page does not pair all with all."""
    u = usable(boxes).select("doc_id", "page", "name", "bbox")
    cell = lambda i: F.floor(G.part("bbox", i) / SHIFT).cast("bigint")
    a = u.select("doc_id", "page", F.col("name").alias("name_a"), F.col("bbox").alias("box_a"), cell(0).alias("cx"), cell(1).alias("cy"))
    off = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    b = u.select("doc_id", "page", F.col("name").alias("name_b"), F.col("bbox").alias("box_b"), cell(0).alias("bx"), cell(1).alias("by"), F.explode(off).alias("o"))
    b = b.select("doc_id", "page", "name_b", "box_b", (F.col("bx") + F.col("o.x")).alias("cx"), (F.col("by") + F.col("o.y")).alias("cy"))
    j = a.join(b, ["doc_id", "page", "cx", "cy"]).where("name_a < name_b")
    return j.where((G.largest_shift("box_a", "box_b") <= SHIFT) & (G.iou("box_a", "box_b") >= OVERLAP)).select("doc_id", "page", "name_a", "name_b")


def aliases(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, name, alias_of): each later box that nearly coincides with an earlier kept one. An alias is never
    a target, so boxes of a page are taken in order; only boxes with a near neighbour reach the per-page step."""
    pairs = near_pairs(boxes)

    def greedy(key, pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[str, list[str]] = {}
        for a, b in zip(pdf.name_a, pdf.name_b):
            before.setdefault(b, []).append(a)
        alias: dict[str, str] = {}
        for name in sorted(before):
            target = next((a for a in sorted(before[name]) if a not in alias), None)
            if target is not None:
                alias[name] = target
        return pd.DataFrame({"doc_id": key[0], "page": key[1], "name": list(alias), "alias_of": list(alias.values())})

    return pairs.groupBy("doc_id", "page").applyInPandas(greedy, "doc_id int, page int, name string, alias_of string")


def without_aliases(sections: DataFrame, alias: DataFrame) -> DataFrame:
    """Section texts (doc_id, key, text) in which an alias's token is dropped where its original stands in the same
    text; other aliases stay. Running it again changes nothing."""
    names = sections.select("doc_id", "key", "text", F.explode_outer(X.image_names("text")).alias("name"))
    hit = names.join(alias.select("doc_id", "name", "alias_of"), ["doc_id", "name"], "left").where("alias_of is not null and contains(text, concat('[[eq:', alias_of, ']]'))")
    drop = hit.groupBy("doc_id", "key").agg(F.collect_set("name").alias("gone"))
    joined = sections.join(drop, ["doc_id", "key"], "left")
    text = F.aggregate(F.coalesce("gone", F.array().cast("array<string>")), F.col("text"), lambda t, n: F.replace(t, F.concat(F.lit("[[eq:"), n, F.lit("]]")), F.lit("")))
    return joined.select("doc_id", "key", text.alias("text"), F.size(F.coalesce("gone", F.array())).alias("dropped"))


def rewritten_refs(texts: DataFrame, alias: DataFrame) -> DataFrame:
    """Edited texts (key, text) with alias tokens turned into the original, or dropped where it is already there."""
    tok = lambda c: F.concat(F.lit("[[eq:"), c, F.lit("]]"))
    pairs = texts.select("key", F.explode(X.image_names("text")).alias("name")).distinct().join(alias.select("name", "alias_of"), "name")
    maps = pairs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("name", "alias_of"))).alias("m"))
    t = F.aggregate(F.coalesce("m", F.array().cast("array<struct<name:string,alias_of:string>>")), F.col("text"), lambda acc, e: F.replace(acc, tok(e["name"]), F.when(F.contains(acc, tok(e["alias_of"])), F.lit("")).otherwise(tok(e["alias_of"]))))
    return texts.join(maps, "key", "left").select("key", t.alias("text"))


def remaining_images(names, readings):
    """Names that stay pictures: no reading, a figure, unsure or unread; each once, in order. (Columns in, Column out.)"""
    r = lambda n: F.try_element_at(readings, n)
    stays = lambda n: r(n).isNull() | F.coalesce(r(n)["source"] == "figure", F.lit(False)) | F.coalesce(r(n)["needs_review"], F.lit(False)) | r(n)["latex"].isNull()
    return F.array_distinct(F.filter(names, stays))


def recognise(features: DataFrame) -> DataFrame:
    """Readings by the cheapest test that applies: figure, scan, symbol match, model. One decision per distinct crop.

    features: (name, md5, width, height, figure_reason, is_scan, glyph, glyph_score, model_latex)."""
    once = features.groupBy("md5").agg(*(F.min_by(c, "name").alias(c) for c in ("name", "width", "height", "figure_reason", "is_scan", "glyph", "glyph_score", "model_latex")))
    small, tall = F.col("width") < 100, F.col("height") > 250
    by_glyph = small & (F.coalesce("glyph_score", F.lit(0.0)) >= 0.7)
    source = F.when(F.col("figure_reason").isNotNull(), "figure").when(F.col("is_scan"), "scan").when(by_glyph, "glyph").otherwise("model")
    latex = F.when(source == "glyph", F.col("glyph")).when(source == "model", F.col("model_latex"))
    unsure = (source == "scan") | ((source == "model") & (small | tall | latex.isNull() | (latex == "")))
    decided = once.select("md5", source.alias("source"), latex.alias("latex"), unsure.alias("needs_review"), F.when(source == "glyph", F.round("glyph_score", 2)).alias("confidence"))
    return features.select("name", "md5").join(decided, "md5").select("name", "md5", "source", "latex", "needs_review", "confidence")


def with_model(crops: DataFrame, model: Callable[[list[bytes]], list[str | None]], batch: int = 16) -> DataFrame:
    """(md5, model_latex) of distinct crops (md5, shape, content) through a given model, in batches of equal shape.
    A failing batch is tried again one at a time; a crop that still fails has no reading."""

    def one_by_one(items: list[bytes]) -> list[str | None]:
        out: list[str | None] = []
        for x in items:
            try:
                out.append(model([x])[0])
            except Exception:
                out.append(None)
        return out

    def run(batches):
        for pdf in batches:
            out: dict[str, str | None] = {}
            for _, g in pdf.groupby("shape", sort=True):
                for i in range(0, len(g), batch):
                    part = g.iloc[i : i + batch]
                    items = list(part.content)
                    try:
                        got = model(items)
                    except Exception:
                        got = one_by_one(items)
                    out.update(zip(part.md5, got))
            yield pd.DataFrame({"md5": list(out), "model_latex": list(out.values())})

    return crops.dropDuplicates(["md5"]).select("md5", "shape", "content").mapInPandas(run, "md5 string, model_latex string")


def validated(readings: DataFrame, check=None) -> DataFrame:
    """Readings with failures marked. The default check only balances braces and delimiters - it is weaker than a
    renderer; pass a Column function from latex to an error text for a real one. Each distinct formula is checked once."""
    opens = lambda c, a: F.length(F.regexp_replace(c, a, ""))
    default = lambda c: F.when(opens(c, r"[^{]") != opens(c, r"[^}]"), "unbalanced braces").when(F.size(F.regexp_extract_all(c, F.lit(r"\\left\b"), F.lit(0))) != F.size(F.regexp_extract_all(c, F.lit(r"\\right\b"), F.lit(0))), "unbalanced \\left and \\right")
    errors = readings.where("coalesce(latex, '') <> '' and not coalesce(needs_review, false)").select("latex").distinct().withColumn("error", F.substring((check or default)(F.col("latex")), 1, 200)).where("error is not null")
    j = readings.join(errors, "latex", "left")
    bad = F.col("error").isNotNull() & ~F.coalesce("needs_review", F.lit(False))
    return j.select(*[c for c in readings.columns if c not in ("needs_review",)], (F.coalesce("needs_review", F.lit(False)) | bad).alias("needs_review"), F.when(bad, F.col("error")).alias("katex_error"))


def with_result(readings: DataFrame, results: DataFrame) -> DataFrame:
    """Reviewed results written to every section that holds the picture: (doc_id, key, name, latex, source, needs_review)
    with (doc_id, name, latex, source)."""
    r = results.select("doc_id", "name", F.col("latex").alias("new_latex"), F.col("source").alias("new_source"), F.lit(True).alias("hit"))
    j = readings.join(r, ["doc_id", "name"], "left")
    return j.select("doc_id", "key", "name", F.when(F.col("hit"), F.col("new_latex")).otherwise(F.col("latex")).alias("latex"), F.when(F.col("hit"), F.col("new_source")).otherwise(F.col("source")).alias("source"), F.when(F.col("hit"), False).otherwise(F.col("needs_review")).alias("needs_review"))


def without_images(sections: DataFrame, deleted: DataFrame) -> DataFrame:
    """Section texts (doc_id, key, text) without the deleted pictures (doc_id, name); blanks squeezed."""
    gone = deleted.groupBy("doc_id").agg(F.collect_set("name").alias("gone"))
    j = sections.join(gone, "doc_id", "left")
    hit = F.filter(F.coalesce("gone", F.array().cast("array<string>")), lambda n: F.contains(F.col("text"), F.concat(F.lit("[[eq:"), n, F.lit("]]"))))
    j = j.withColumn("hit", hit)
    t = F.aggregate("hit", F.col("text"), lambda acc, n: F.replace(acc, F.concat(F.lit("[[eq:"), n, F.lit("]]")), F.lit("")))
    new = F.when(F.size("hit") > 0, X.strip(F.regexp_replace(t, r"[ \t]{2,}", " "))).otherwise(F.col("text"))
    return j.select("doc_id", "key", new.alias("text"), F.size("hit").alias("removed"))


def figures_in(selections: DataFrame, boxes: DataFrame) -> DataFrame:
    """(sel_id, name): pictures whose centre lies in a selection on the same page (doc_id, page, sel_id, area)."""
    b = boxes.where(F.size("bbox") == 4).select("doc_id", "page", "name", "bbox")
    return selections.join(b, ["doc_id", "page"]).where(G.centre_inside("bbox", "area")).select("sel_id", "doc_id", "page", "name")


def next_manual_name(existing: DataFrame) -> DataFrame:
    """(doc_id, name): the next free manual picture name of each document."""
    n = F.regexp_extract("name", r"^manual_(\d+)", 1).try_cast("int")
    return existing.groupBy("doc_id").agg(F.coalesce(F.max(n), F.lit(-1)).alias("n")).select("doc_id", F.format_string("manual_%03d.png", F.col("n") + 1).alias("name"))
