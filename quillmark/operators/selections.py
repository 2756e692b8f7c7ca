"""Areas drawn on a page: crops kept as pictures, areas read into a question part, pictures turned into text, questions
added by hand; and the contract of the models that read them.

Areas are in shares of the page, boxes in points. Models are given callables; nothing here talks to a network.

Cases: an area that is no area gives its row an error and changes nothing; null texts count as empty; requests to
unknown questions are errors; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions import text as X
from quillmark.operators import review, structure
from quillmark.operators.parts import reference

#: Least side of a crop or a read area, of an added question (points), of a picture's area (share), most
#: areas of one reading, share and number of dark pixels of a blank area.
LEAST_CROP, LEAST_QUESTION, LEAST_SHARE, MOST_AREAS, BLANK_SHARE, BLANK_PIXELS = 5.0, 20.0, 0.005, 8, 0.0005, 40


def in_points(area, width, height) -> Column:
    """An area in shares as an ordered box in points, rounded to a tenth; null where it is no area."""
    a, w, h = X._c(area), X._c(width), X._c(height)
    ok = (F.size(a) == 4) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    r1 = lambda v: F.floor(v * 10.0 + 0.5).cast("double") / 10.0
    at = lambda i: F.get(a, F.lit(i))
    box = F.array(r1(F.least(at(0), at(2)) * w), r1(F.least(at(1), at(3)) * h), r1(F.greatest(at(0), at(2)) * w), r1(F.greatest(at(1), at(3)) * h))
    return F.when(F.coalesce(ok, F.lit(False)), box)


def large_enough(box, least: float) -> Column:
    return F.coalesce((G.part(box, 2) - G.part(box, 0) >= least) & (G.part(box, 3) - G.part(box, 1) >= least), F.lit(False))


def cropped(crops: DataFrame, texts: DataFrame, taken: DataFrame, width: float = 612.0, height: float = 792.0) -> tuple[DataFrame, DataFrame]:
    """(pictures, texts): crops (doc_id, key, part, page, area, pos) become pictures manual_NNN.png, numbered on from
    the names taken (doc_id, name) in order of pos, and are appended to the effective text (override, else automatic) of
    their part. pictures (doc_id, key, part, name, page, bbox, error); texts (doc_id, key, part, text) only where one
    changed. Numbers run per document: only crops of one document meet, and those are drawn by hand."""
    c = crops.join(texts.select("doc_id", "key", "part", F.lit(True).alias("known")).distinct(), ["doc_id", "key", "part"], "left").withColumn("bbox", in_points("area", F.lit(width), F.lit(height)))
    error = F.when(F.col("known").isNull(), "unknown question").when(F.col("bbox").isNull(), "not an area").when(~large_enough("bbox", LEAST_CROP), "too small")
    c = c.withColumn("error", error)
    top = taken.groupBy("doc_id").agg(F.coalesce(F.max(F.regexp_extract("name", r"^manual_(\d+)", 1).try_cast("int")), F.lit(0)).alias("top"))
    good = c.where("error is null").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "key", "part")))
    good = good.join(top, "doc_id", "left").withColumn("name", F.format_string("manual_%03d.png", F.col("n") + F.coalesce("top", F.lit(0))))
    new = good.groupBy("doc_id", "key", "part").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("new"))
    effective = F.coalesce("override", "auto", F.lit(""))
    lines = F.concat(F.array(F.regexp_replace(effective, r"\s+$", "")), F.transform("new", lambda e: reference(e["name"])))
    changed = texts.join(new, ["doc_id", "key", "part"]).select("doc_id", "key", "part", X.strip(F.array_join(lines, "\n")).alias("text"))
    cols = ["doc_id", "key", "part", "name", "page", "bbox", "error"]
    return good.select(*cols).unionByName(c.where("error is not null").withColumn("name", F.lit(None).cast("string")).select(*cols)), changed


def planned(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """(req_id, doc_id, key, part, areas, error) of requests to read one to eight areas (page, area) in order; areas come
    out as boxes in points. sizes (doc_id, page, width, height)."""
    r = requests.select("req_id", "doc_id", "key", "part", F.posexplode_outer("areas").alias("n", "a"))
    j = r.withColumn("page", F.col("a.page")).join(sizes, ["doc_id", "page"], "left").withColumn("bbox", in_points("a.area", "width", "height"))
    fault = F.when(F.col("a").isNull(), "no area").when(F.col("width").isNull(), "no such page").when(F.col("bbox").isNull(), "not an area").when(~large_enough("bbox", LEAST_CROP), "too small")
    g = j.groupBy("req_id", "doc_id", "key", "part").agg(F.array_sort(F.collect_list(F.struct("n", "page", "bbox"))).alias("areas"), F.min_by(fault, F.when(fault.isNotNull(), F.coalesce("n", F.lit(0)))).alias("fault"), F.count("*").alias("c"))
    error = F.when(~F.col("part").isin("question", "solution"), "choose question or solution").when(F.col("c") > MOST_AREAS, "too many areas").otherwise(F.col("fault"))
    return g.select("req_id", "doc_id", "key", "part", F.transform("areas", lambda e: F.struct(e["page"].alias("page"), e["bbox"].alias("bbox"))).alias("areas"), error.alias("error"))


def figures_selected(plan: DataFrame, figures: DataFrame) -> DataFrame:
    """(req_id, figures): figures (doc_id, name, page, bbox, pos) whose centre lies in one of the areas, in order, each once."""
    a = plan.where("error is null").select("req_id", "doc_id", F.explode("areas").alias("a")).select("req_id", "doc_id", "a.page", F.col("a.bbox").alias("area"))
    hit = a.join(figures, ["doc_id", "page"]).where(G.centre_inside("bbox", "area")).groupBy("req_id", "name").agg(F.min("pos").alias("pos"))
    return hit.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]).alias("figures"))


def extracted(plan: DataFrame, answers: DataFrame, texts: DataFrame, figures: DataFrame, taken: DataFrame) -> DataFrame:
    """(req_id, doc_id, key, part, text, new_names, error): what a part reads after its areas were read. answers (req_id,
    question, solution, dark, pixels); texts (doc_id, key, part, text) are the effective ones; figures as
    figures_selected gives them. Nothing read of a blank area is an error, of an inked one the area itself is kept as a
    picture; so are figures the answer saw and the page has none for, under the next free names."""
    j = plan.join(answers, "req_id", "left").join(texts.select("doc_id", "key", "part", F.col("text").alias("original")), ["doc_id", "key", "part"], "left").join(figures, "req_id", "left")
    none = F.array().cast("array<string>")
    said = F.concat_ws("\n\n", F.nullif(X.strip(F.coalesce("question", F.lit(""))), F.lit("")), F.nullif(X.strip(F.coalesce("solution", F.lit(""))), F.lit("")))
    blank = F.coalesce("dark", F.lit(0)) <= F.greatest(F.lit(float(BLANK_PIXELS)), F.coalesce("pixels", F.lit(0)) * BLANK_SHARE)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("original").isNull(), "unknown question").when((said == "") & blank, "the area is blank")
    j = j.withColumn("fault", error).withColumn("said", F.when(said == "", "[[FIGURE]]").otherwise(said)).withColumn("figures", F.coalesce("figures", none))
    seen = F.size(F.regexp_extract_all("said", F.lit(r"\[\[FIGURE\]\]"), F.lit(0)))
    j = j.withColumn("want", F.when(F.col("fault").isNull() & (seen > F.size("figures")), F.size("areas")).otherwise(0))
    top = taken.groupBy("doc_id").agg(F.coalesce(F.max(F.regexp_extract("name", r"^manual_(\d+)", 1).try_cast("int")), F.lit(0)).alias("top"))
    # names run on per document, over the few requests that need any and without their texts
    before = F.coalesce(F.sum("want").over(W.partitionBy("doc_id").orderBy("req_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("top", F.lit(0))
    first = j.where("want > 0").select("req_id", "doc_id", "want").join(top, "doc_id", "left").select("req_id", before.cast("int").alias("from"))
    j = j.join(first, "req_id", "left")
    names = F.when(F.col("want") > 0, F.transform(F.sequence(F.lit(1), F.greatest("want", F.lit(1))), lambda i: F.format_string("manual_%03d.png", F.col("from") + i))).otherwise(none)
    j = j.withColumn("new_names", names).withColumn("all_figures", F.when(F.col("fault").isNull(), F.concat("figures", "new_names")).otherwise(none))
    p = review.place_figures(j, "said", "original", "all_figures")
    return p.select("req_id", "doc_id", "key", "part", F.when(F.col("fault").isNull(), X.to_paren_delims("placed")).alias("text"), "new_names", F.col("fault").alias("error"))


def first_replaced(text, old, new) -> Column:
    """A text with the first occurrence of another replaced."""
    t, o = X._c(text), X._c(old)
    at = F.position(o, t)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), X._c(new), F.substring(t, at + F.length(o), F.length(t)))).otherwise(t)


def picture_read(requests: DataFrame, texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(req_id, doc_id, key, part, text, error): one picture reference of a part replaced by what was read. requests
    (req_id, doc_id, key, part, name, area, seen): seen is the text the reading started from; texts (doc_id, key, part,
    text) the effective ones now; answers (req_id, question, solution, faults). Refused are areas that are none, pictures
    the text no longer holds, empty or figure-only answers, invalid maths, and texts that changed meanwhile."""
    j = requests.join(texts, ["doc_id", "key", "part"], "left").join(answers, "req_id", "left")
    said = F.concat_ws("\n", F.nullif(X.strip(F.coalesce("question", F.lit(""))), F.lit("")), F.nullif(X.strip(F.coalesce("solution", F.lit(""))), F.lit("")))
    a = lambda i: F.get("area", F.lit(i))
    valid = (F.size("area") == 4) & F.forall("area", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1)) & (a(2) - a(0) >= LEAST_SHARE) & (a(3) - a(1) >= LEAST_SHARE)
    ref = reference("name")
    error = (
        F.when(~F.coalesce(F.col("name").rlike(r"^[^/\\]+\.png$"), F.lit(False)), "not a picture")
        .when(~F.coalesce(F.contains("seen", ref), F.lit(False)), "the picture is no longer in the text")
        .when(~F.coalesce(valid, F.lit(False)), "not an area")
        .when((said == "") | F.contains(said, F.lit("[[FIGURE]]")), "no text was read")
        .when(F.coalesce(F.size("faults"), F.lit(0)) > 0, "invalid maths")
        .when(~F.col("text").eqNullSafe(F.col("seen")), "the text changed meanwhile")
    )
    return j.select("req_id", "doc_id", "key", "part", F.when(error.isNull(), first_replaced("text", ref, X.to_paren_delims(said))).alias("text"), error.alias("error"))


def added_questions(drawn: DataFrame, sections: DataFrame, lines: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(doc_id, key, page, bbox, exercise, number, label, stem, solution, figures_seen, error): questions the splitter
    missed, drawn (id, doc_id, page, area, stem, solution). Their place is the page's exercise; several on one page get
    numbers in order of id. Figure marks are dropped and counted."""
    d = drawn.withColumn("bbox", in_points("area", F.lit(width), F.lit(height)))
    d = d.join(structure.slot_for(sections, lines), ["doc_id", "page"], "left")
    error = F.when(F.col("next_number").isNull(), "no such page").when(F.col("bbox").isNull(), "not an area").when(~large_enough("bbox", LEAST_QUESTION), "too small")
    d = d.withColumn("error", error)
    ok = F.col("error").isNull()
    turn = F.count_if(ok).over(W.partitionBy("doc_id", "exercise").orderBy("id")) - 1
    number = F.when(ok, F.col("next_number") + turn).cast("int")
    marks = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[FIGURE\]\]"), F.lit(0)))
    clean = lambda c: X.to_paren_delims(X.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\[FIGURE\]\]\s*", "")))
    return d.select(
        "doc_id", F.concat(F.lit("add-"), "id").alias("key"), "page", "bbox", "exercise", number.alias("number"), number.cast("string").alias("label"), clean(F.col("stem")).alias("stem"), clean(F.col("solution")).alias("solution"), (marks(F.col("stem")) + marks(F.col("solution"))).alias("figures_seen"), "error"
    )


def reread(parts: DataFrame, readings: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, key, part, text, warned): both parts of questions read anew. parts (doc_id, key, part, text, equations,
    override), readings as parts has them, answers (doc_id, key, question, solution, faults). The question's figures are
    put back where they stood, those of its own part in the question and the others in the solution; a figure taken out
    by an earlier edit stays out. Questions without an answer keep what they have (no row)."""
    none = F.array().cast("array<string>")
    neutral = F.regexp_replace(F.coalesce("text", F.lit("")), X.IMAGE_TOKEN, "![](img:$1)")
    p = parts.withColumn("neutral", neutral).withColumn("effective", F.coalesce("override", "neutral"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    q = p.groupBy("doc_id", "key").agg(F.coalesce(of("question", "equations"), none).alias("qe"), F.coalesce(of("solution", "equations"), none).alias("se"), F.concat_ws("\n", of("question", "effective"), of("solution", "effective")).alias("now"), F.bool_or(F.col("override").isNotNull()).alias("edited"))
    figures = readings.where("source = 'figure'").groupBy("doc_id", "key").agg(F.collect_set("name").alias("figures"))
    q = q.join(answers, ["doc_id", "key"]).join(figures, ["doc_id", "key"], "left")
    stays = lambda n: F.array_contains(F.coalesce("figures", none), n) & (~F.col("edited") | F.contains(F.col("now"), reference(n)))
    q = q.withColumn("qf", F.filter(F.array_distinct("qe"), stays))
    q = q.withColumn("sf", F.array_except(F.filter(F.array_distinct("se"), stays), "qf"))
    j = p.select("doc_id", "key", "part", "neutral").join(q, ["doc_id", "key"]).withColumn("said", F.when(F.col("part") == "question", F.col("question")).otherwise(F.col("solution"))).withColumn("own", F.when(F.col("part") == "question", F.col("qf")).otherwise(F.col("sf")))
    placed = review.place_figures(j.select("doc_id", "key", "part", "said", "neutral", "own", "faults"), "said", "neutral", "own")
    return placed.select("doc_id", "key", "part", X.to_paren_delims("placed").alias("text"), (F.coalesce(F.size("faults"), F.lit(0)) > 0).alias("warned"))


def transcribed(rows: DataFrame, ask: Callable[[str, list[str] | None], dict], faults: Callable[[str], list[str]]) -> DataFrame:
    """(id, text, faults, error, calls) of rows (id, payload) read by a model. ask(payload, None) gives text and whether
    it was cut; a cut answer is an error. An answer with faults or control characters is asked for once more with the
    faults named; the second one counts if it has fewer. What still holds control characters is an error, and so is
    whatever the model raises: the row fails, not the job."""
    import re

    bad = re.compile(X.BAD_CHARS)

    def read(payload: str) -> tuple[str | None, list[str], str | None, int]:
        first = ask(payload, None)
        if first.get("cut"):
            return None, [], "cut off", 1
        text = first.get("text") or ""
        found, odd, calls = faults(text), bool(bad.search(text)), 1
        if found or odd:
            second = ask(payload, found[:15])
            calls = 2
            other = second.get("text") or ""
            again = faults(other)
            if not second.get("cut") and not bad.search(other) and (odd or len(again) < len(found)):
                text, found, odd = other, again, False
        return (None, found, "control characters", calls) if odd else (text, found, None, calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, payload in zip(b["id"], b["payload"]):
                try:
                    out.append((i, *read(payload)))
                except Exception as e:
                    out.append((i, None, [], str(e)[:200], 1))
            yield pd.DataFrame(out, columns=["id", "text", "faults", "error", "calls"])

    return rows.select(F.col("id").cast("string").alias("id"), "payload").mapInPandas(run, "id string, text string, faults array<string>, error string, calls int")


def accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """Answers (by, said, truth) with how many there are, how many were given and are right; null truths do not count."""
    a = answers.where("truth is not null")
    g = a.groupBy(*by).agg(F.count("*").alias("n"), F.count("said").alias("given"), F.count_if(F.col("said") == F.col("truth")).alias("correct"))
    return g.withColumn("share", F.col("correct") / F.col("n"))
