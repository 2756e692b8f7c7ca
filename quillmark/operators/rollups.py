"""Aggregates and window shapes: usage, parent rows, signatures, option lists, islands, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as X


def usage(calls: DataFrame, keys: list[str], inputs: str, outputs: str) -> DataFrame:
    """Calls, input and output per key; null amounts count as nothing."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.coalesce(F.sum(inputs), F.lit(0)).alias("input"), F.coalesce(F.sum(outputs), F.lit(0)).alias("output"))


def source_counts(readings: DataFrame) -> DataFrame:
    """Readings by source, and how many need a look."""
    return readings.groupBy("source").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("needs_review"))


def parents(records: DataFrame) -> DataFrame:
    """One row per document over its question records, each id counted once: count, most frequent type (the least of
    equals), any previous-year question, and the first record's subject, class, exam and chapter.

    The mode is counted per (document, type) first, so one document with a third of all rows is combined before the
    shuffle."""
    q = records.where("documentId is not null and id is not null")
    order = F.struct("createdAt", "id")
    once = q.groupBy("documentId", "id").agg(F.max_by(F.struct("questionType", "isPyq", "subject", "className", "exam", F.col("path.chapter").alias("chapter"), "createdAt"), F.struct("updatedAt", F.xxhash64("questionType", "subject", "className", "exam"))).alias("r")).select("documentId", "id", "r.*")
    per = once.groupBy("documentId", "questionType").agg(F.count("*").alias("n"))
    mode = per.where("questionType is not null").groupBy("documentId").agg(F.min_by("questionType", F.struct(-F.col("n"), F.col("questionType"))).alias("questionType"))
    head = once.groupBy("documentId").agg(
        F.count("*").alias("questionCount"),
        F.bool_or(F.coalesce("isPyq", F.lit(False))).alias("pyq"),
        F.min_by(F.struct("subject", "className", X.normalize_exam("exam").alias("exam"), "chapter"), order).alias("f"),
    )
    return head.join(mode, "documentId", "left").select("documentId", "questionCount", "questionType", "pyq", "f.subject", "f.className", "f.exam", "f.chapter")


def distinct_options(tables: list[tuple[DataFrame, str]], field: str, constants: tuple[str, ...] = ()) -> DataFrame:
    """Distinct non-blank values of one field in several tables and constants, ordered without regard to case."""
    out = None
    for df, column in tables:
        one = df.select(X.strip(column).alias("value")).where("value <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    if constants:
        extra = tables[0][0].sparkSession.createDataFrame([(c,) for c in constants], "value string")
        out = out.unionByName(extra)
    return out.distinct().select(F.lit(field).alias("field"), "value", F.lower("value").alias("sort_key")).orderBy("sort_key", "value")


def signature(records: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """A digest per group over its records, whatever their order; fields that only say when are left to the caller to
    leave out. Two levels: records are digested one by one, then per bucket of digests (4,096 a group), then the buckets,
    so a group of any size moves 64 characters a record and is never in one task."""
    line = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    part = records.select(group, line.alias("h")).groupBy(group, F.substring("h", 1, 3).alias("bucket")).agg(joined("h").alias("d"), F.count("*").alias("n"))
    return part.groupBy(group).agg(joined(F.concat("bucket", "d")).alias("signature"), F.sum("n").alias("records"))


def same_content(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that occur more than once: digest, how often, the least key that holds it."""
    return rows.groupBy(F.md5(F.lower(text)).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def keep_first(rows: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each kind in the given order; min_by combines before the shuffle."""
    cols = rows.columns
    keyed = rows.select(*cols, *(X._c(b).alias(f"__k{i}") for i, b in enumerate(by)))
    keys = [f"__k{i}" for i in range(len(by))]
    g = keyed.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*[X._c(o) for o in order])).alias("r"))
    return g.select(*(F.col(f"r.{c}").alias(c) for c in cols))


def repeated_lines(documents: DataFrame, least: int = 2) -> DataFrame:
    """Lines found more than once over all documents, with the number of documents: counted per document first."""
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("line")).where("line <> ''")
    per = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= least)


def numbered_batches(rows: DataFrame, group: str, order: list[str], size: int, block: Column) -> DataFrame:
    """Batches of a fixed size in order within each group. ``block`` cuts the order into stretches (it must not fall as
    the order goes on): rows are numbered per stretch, and what came before is added, so no task numbers a whole group."""
    d = rows.withColumn("__b", block)
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = d.groupBy(group, "__b").agg(F.count("*").alias("__n")).select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c"))
    local = d.withColumn("__r", F.row_number().over(W.partitionBy(group, "__b").orderBy(*order)) - 1)
    return local.join(carry, [group, "__b"]).withColumn("batch", F.floor((F.col("__r") + F.col("__c")) / size).cast("int")).drop("__b", "__r", "__c")


def islands(rows: DataFrame, group: str, order: list[str], value: str, block: Column) -> DataFrame:
    """Runs of equal values in order: (group, run, value, n, first_at, last_at); nulls are equal to nulls. ``block`` cuts
    the order into stretches as above: runs are found per stretch and joined over the cuts, one row a stretch."""
    d = rows.withColumn("__b", block)
    by = W.partitionBy(group, "__b").orderBy(*order)
    starts = (F.row_number().over(by) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(by))
    d = d.withColumn("__s", starts.cast("int")).withColumn("__l", F.sum("__s").over(by.rowsBetween(W.unboundedPreceding, 0)))
    at = F.struct(*order)
    v = F.struct(F.col(value).alias("v"))  # a struct, so that a null value is a value
    ends = d.groupBy(group, "__b").agg(F.sum("__s").alias("__n"), F.min_by(v, at).alias("__first"), F.max_by(v, at).alias("__last"))
    over = W.partitionBy(group).orderBy("__b")
    ends = ends.withColumn("__m", F.coalesce(F.col("__first").eqNullSafe(F.lag("__last").over(over)), F.lit(False)).cast("int"))
    prior = over.rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(group, "__b", (F.coalesce(F.sum("__n").over(prior), F.lit(0)) - F.sum("__m").over(over.rowsBetween(W.unboundedPreceding, 0))).alias("__c"))
    per = d.groupBy(group, "__b", "__l", value).agg(F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))
    j = per.join(carry, [group, "__b"]).withColumn("run", F.col("__l") + F.col("__c"))
    return j.groupBy(group, "run", value).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def option_bodies(marks: DataFrame) -> DataFrame:
    """Body of each mark (id, text, start, end): up to the next mark, or the end of the text."""
    nxt = F.lead("start").over(W.partitionBy("id").orderBy("start"))
    stop = F.coalesce(nxt, F.length("text"))
    return marks.select("id", "start", X.strip(F.substring(F.col("text"), F.col("end") + 1, stop - F.col("end"))).alias("body"))


def script_runs(tokens: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, formula): tokens (key, pos, kind, tex) in order as one formula; runs of one script kind share their braces.
    The tokens of one formula are few, so they are folded as an array."""
    g = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "kind", "tex"))).alias("t"))
    opened = lambda k: F.when(k == "sup", "^{").when(k == "sub", "_{").otherwise("")
    closed = lambda k: F.when(k.isin("sup", "sub"), "}").otherwise("")
    start = F.struct(F.lit("").alias("out"), F.lit("inline").alias("kind"))

    def step(acc, t):
        seam = F.when(acc["kind"] == t["kind"], "").otherwise(F.concat(closed(acc["kind"]), opened(t["kind"])))
        gap = F.when((acc["kind"] == "inline") & (t["kind"] == "inline") & acc["out"].rlike(r"\\[A-Za-z]+$") & t["tex"].rlike(r"^\p{L}"), " ").otherwise("")
        return F.struct(F.concat(acc["out"], seam, gap, t["tex"]).alias("out"), t["kind"].alias("kind"))

    return g.select(key, F.aggregate("t", start, step, lambda a: F.concat(a["out"], closed(a["kind"]))).alias("formula"))


def inked_runs(rows: DataFrame, group: str, pos: str, inked: str, block: Column) -> DataFrame:
    """(group, first_at, last_at, n): longest stretches of inked positions in order; what is not inked parts them."""
    return islands(rows, group, [pos], inked, block).where(F.col(inked)).select(group, "first_at", "last_at", "n")


def weakest(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, weakest, n): something read in pieces is as sure as its least sure piece; null scores count as 0."""
    return rows.groupBy(key).agg(F.min(F.coalesce(score, F.lit(0.0))).alias("weakest"), F.count("*").alias("n"))


def run_totals(outcomes: DataFrame, key: str) -> DataFrame:
    """Outcomes (key, outcome, warning) of a run: done, new, updated, reused, missing, failed and with a warning."""
    kinds = ("done", "new", "updated", "reused", "missing", "failed")
    return outcomes.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds), F.count_if(F.coalesce("warning", F.lit("")) != "").alias("warnings"))


def first_items(items, n: int) -> Column:
    """The first n of a list: a report's shortening, null stays null."""
    return F.slice(items, 1, n)


def latest_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.max(order[0]).alias(order[0]))


def stages(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage").agg(F.count("*").alias("n"))


def gate(records: DataFrame) -> DataFrame:
    """One row that says whether a set of records can be handed on: rows, incomplete, flagged."""
    from quillmark.operators.review import missing_fields

    g = records.agg(F.count("*").alias("records"), F.count_if(F.size(missing_fields()) > 0).alias("incomplete"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"))
    return g.withColumn("passes", (F.col("records") > 0) & (F.col("incomplete") == 0) & (F.col("flagged") == 0))


def finalised(records: DataFrame, key: str, images: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per set (key) that says whether it can be closed: records, incomplete, flagged, missing pictures, whether
    its signature stood still (before and after: key, signature), and the first reason against it. A set without records
    does not pass. images (name) are the pictures at hand."""
    from quillmark.operators.review import missing_fields

    bad = F.size(missing_fields()) > 0
    g = records.groupBy(key).agg(F.count("*").alias("records"), F.count_if(bad).alias("incomplete"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"))
    used = records.select(key, F.explode("imageCrops").alias("c")).select(key, F.regexp_replace("c.url", "^.*/", "").alias("name")).where("name <> ''").distinct()
    gone = used.join(images.select("name").distinct(), "name", "left_anti").groupBy(key).agg(F.count("*").alias("missing"))
    j = before.select(key, F.col("signature").alias("s0")).join(g, key, "left").join(gone, key, "left").join(after.select(key, F.col("signature").alias("s1")), key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    reason = F.when(n("records") == 0, "no records").when(n("incomplete") > 0, "incomplete").when(n("flagged") > 0, "flagged").when(n("missing") > 0, "missing pictures").when(~F.col("s0").eqNullSafe(F.col("s1")), "changed meanwhile")
    return j.select(key, *(n(c).alias(c) for c in ("records", "incomplete", "flagged", "missing")), reason.alias("reason"))
