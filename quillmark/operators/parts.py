"""Parts of questions as rows and what is done to them: pictures dropped, read, kept or removed, documents re-split.

A part is a row (doc_id, key, title, label, page_start, part, text, equations), part being question or solution; its
readings are rows (doc_id, key, part, name, latex, source, needs_review). Every change gives new rows.

Cases: null texts count as empty ones; parts without pictures pass unchanged; repeated rows of one (doc_id, key, part)
each change alike; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import review

PART = ["doc_id", "key", "part"]


def token(name) -> Column:
    return F.concat(F.lit("[[eq:"), X._c(name), F.lit("]]"))


def reference(name) -> Column:
    return F.concat(F.lit("![](img:"), X._c(name), F.lit(")"))


def parts_of(sections: DataFrame) -> DataFrame:
    """Questions to their two parts, with the pictures each refers to."""
    two = F.expr("stack(2, 'question', question_text, 'solution', solution_text) as (part, text)")
    s = sections.select("doc_id", F.concat_ws("-", "exercise", "question").alias("key"), "title", "label", "page_start", two)
    return s.select("*", F.coalesce(X.image_names("text"), F.array().cast("array<string>")).alias("equations"))


def holding(parts: DataFrame) -> DataFrame:
    """(doc_id, name, key, part): the parts that refer to a picture, each once."""
    return parts.select("doc_id", F.explode(F.array_distinct("equations")).alias("name"), "key", "part")


def embedded_additional(parts: DataFrame) -> DataFrame:
    """(doc_id, embedded): whether some part swallowed a later section of additional questions.

    Fixed values: the headings that give it away."""
    hit = F.col("text").rlike(r"(?im)^\s*Additional Exercises\s*$") | F.col("text").rlike(r"(?im)^\s*Question\s+A\d+\s*:")
    return parts.groupBy("doc_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("embedded"))


def with_scans(documents: DataFrame) -> DataFrame:
    """(doc_id, scanned) of documents (doc_id, scanned_pages, names): pages are declared as scanned, or a picture is
    named by the scan reader."""
    return documents.select("doc_id", ((F.coalesce(F.size("scanned_pages"), F.lit(0)) > 0) | F.coalesce(F.exists("names", lambda n: n.contains("_ocr")), F.lit(False))).alias("scanned"))


def figure_anchors(parts: DataFrame) -> DataFrame:
    """(doc_id, key, part, pos, name, anchor, before, trailing): the text a picture stands after, how many texts come
    before it, and whether none follows. Pieces of one text, so arrays do."""
    pieces = F.transform(F.split("text", X.IMAGE_TOKEN, -1), X.strip)
    filled = lambda a: F.filter(a, lambda t: t != "")
    p = parts.select(*PART, pieces.alias("pieces"), F.posexplode(X.image_names("text")).alias("pos", "name"))
    seen, rest = filled(F.slice("pieces", F.lit(1), F.col("pos") + 1)), filled(F.slice("pieces", F.col("pos") + 2, F.size("pieces")))
    return p.select(*PART, "pos", "name", F.try_element_at(seen, F.lit(-1)).alias("anchor"), F.size(seen).alias("before"), (F.size(rest) == 0).alias("trailing"))


def _without(parts: DataFrame, gone: DataFrame, squeeze: bool) -> DataFrame:
    """Parts without the tokens and list entries of names gone (PART, name)."""
    g = gone.groupBy(*PART).agg(F.array_sort(F.collect_set("name")).alias("gone"))
    j = parts.join(g, PART, "left")
    none = F.array().cast("array<string>")
    cut = F.aggregate(F.coalesce("gone", none), F.col("text"), lambda t, n: F.replace(t, token(n), F.lit("")))
    if squeeze:
        cut = F.when(F.col("gone").isNotNull(), X.strip(F.regexp_replace(cut, r"[ \t]{2,}", " "))).otherwise(F.col("text"))
    return j.select(*[c for c in parts.columns if c not in ("text", "equations")], cut.alias("text"), F.array_except("equations", F.coalesce("gone", none)).alias("equations"))


def deduplicated(parts: DataFrame, readings: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, readings, dropped): aliases (doc_id, name, alias_of) leave the text, list and readings of every part that
    also holds their original; other mentions stay. dropped (doc_id, name, alias_of) is the map of what went. Applied to
    its own result it changes nothing."""
    names = parts.select(*PART, "equations", F.explode(F.array_distinct("equations")).alias("name"))
    hit = names.join(alias.select("doc_id", "name", "alias_of"), ["doc_id", "name"]).where(F.array_contains("equations", F.col("alias_of")))
    gone = hit.select(*PART, "name")
    return _without(parts, gone, squeeze=False), readings.join(gone.distinct(), [*PART, "name"], "left_anti"), hit.select("doc_id", "name", "alias_of").distinct()


def removed(parts: DataFrame, readings: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, readings, log): pictures (doc_id, name) taken out of texts, lists and readings; blanks are squeezed where
    one went. log (doc_id, name, occurrences) names every picture that stood somewhere."""
    gone = holding(parts).join(asked.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi")
    log = gone.groupBy("doc_id", "name").agg(F.count("*").alias("occurrences"))
    return _without(parts, gone, squeeze=True), readings.join(gone, [*PART, "name"], "left_anti"), log


def reclassified(readings: DataFrame, features: DataFrame) -> DataFrame:
    """Readings reset where the picture turned out a figure: features (doc_id, name, reason), reason null for none.
    What is a figure or was kept by hand stays."""
    f = features.where("reason is not null").groupBy("doc_id", "name").agg(F.min("reason").alias("reason"))
    j = readings.join(f, ["doc_id", "name"], "left")
    hit = F.col("reason").isNotNull() & ~F.coalesce(F.col("source").isin("figure", "skipped"), F.lit(False))
    return j.select(*PART, "name", F.when(~hit, F.col("latex")).alias("latex"), F.when(hit, "figure").otherwise(F.col("source")).alias("source"), F.when(hit, False).otherwise(F.col("needs_review")).alias("needs_review"))


def readings_carried(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Readings of re-split parts, by picture name: every reading known of the document, where the picture still stands;
    of several the one that sorts last by part. Pictures without a reading have none."""
    last = known.groupBy("doc_id", "name").agg(F.max_by(F.struct("latex", "source", "needs_review"), F.struct("key", "part")).alias("r"))
    return holding(parts).join(last, ["doc_id", "name"]).select(*PART, "name", "r.latex", "r.source", "r.needs_review")


def restructured(fresh: DataFrame, known: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, readings) of a new split: readings carried over by name, deletions applied again."""
    parts, readings, _ = removed(fresh, readings_carried(fresh, known), deleted)
    return parts, readings


def acted(parts: DataFrame, readings: DataFrame, overrides: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(parts, readings, overrides, log) after actions (doc_id, name, action, latex), one a picture: ``ai`` writes a
    reading to every part that holds the picture (a figure where there is no latex), ``skip`` keeps it as an image,
    ``remove`` takes it out. Overrides (doc_id, key, part, text) follow: a removed picture's reference goes, a read one's
    becomes its formula. log (doc_id, name, action, occurrences); a picture that stands nowhere is not in it."""
    at = holding(parts).join(actions, ["doc_id", "name"])
    log = at.groupBy("doc_id", "name", "action").agg(F.count("*").alias("occurrences"))
    parts_, kept, _ = removed(parts, readings, actions.where("action = 'remove'"))
    read = at.where("action in ('ai', 'skip')").select(
        *PART, "name", F.when(F.col("action") == "ai", F.col("latex")).alias("latex"), F.when(F.col("action") == "skip", "skipped").when(F.col("latex").isNull(), "figure").otherwise("ai").alias("source"), F.lit(False).alias("needs_review")
    )
    readings_ = kept.select(read.columns).join(read, [*PART, "name"], "left_anti").unionByName(read)
    stands = log.select("doc_id", "name").distinct()
    swap = actions.join(stands, ["doc_id", "name"], "left_semi").where("action = 'remove' or (action = 'ai' and latex is not null)")
    swap = swap.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("name", F.when(F.col("action") == "ai", F.concat(F.lit("\\("), "latex", F.lit("\\)"))).otherwise(F.lit("")).alias("to")))).alias("swaps"))
    j = overrides.join(swap, "doc_id", "left")
    hits = F.filter(F.coalesce("swaps", F.array().cast("array<struct<name:string,to:string>>")), lambda e: F.contains(F.col("text"), reference(e["name"])))
    new = F.when(F.size(hits) > 0, X.strip(F.aggregate(hits, F.col("text"), lambda t, e: F.replace(t, reference(e["name"]), e["to"])))).otherwise(F.col("text"))
    return parts_, readings_, j.select(*PART, new.alias("text")), log


def migrated(docs: DataFrame, old: DataFrame, new: DataFrame, edits: DataFrame, current: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, questions, edits, orphans) brought to the current version on reading. Documents (doc_id, version) of the
    version before without embedded additional questions only get the new number; others that are behind take the new
    split, and their edits (doc_id, key, edit) move with the questions; edits without a new place are orphans."""
    embedded = embedded_additional(parts_of(old))
    d = docs.join(embedded, "doc_id", "left").select("doc_id", "version", F.coalesce("embedded", F.lit(False)).alias("embedded"))
    behind = d.where((F.coalesce("version", F.lit(0)) < current) & ~((F.coalesce("version", F.lit(0)) == current - 1) & ~F.col("embedded"))).select("doc_id")
    moved = behind.withColumn("moved", F.lit(True))
    mapping = review.remap(old.join(behind, "doc_id", "left_semi"), new.join(behind, "doc_id", "left_semi"))
    names = old.select("doc_id", F.concat_ws("-", "exercise", "question").alias("key"), F.concat_ws("|", "title", "label").alias("label"))
    kept, orphans = review.carried(edits.join(behind, "doc_id", "left_semi"), mapping, names)
    questions = old.join(behind, "doc_id", "left_anti").unionByName(new.join(behind, "doc_id", "left_semi").select(*old.columns))
    docs_ = d.join(moved, "doc_id", "left").select("doc_id", F.lit(current).alias("version"), F.coalesce("moved", F.lit(False)).alias("split_again"))
    return docs_, questions, edits.join(behind, "doc_id", "left_anti").unionByName(kept.select(*edits.columns)), orphans
