"""Queries over files, versions, jobs and models: what stands around the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import clusters, images, lines, review, selections, sets, syllabus
from quillmark.operators import rollups as R
from quillmark.plans import bank, edits, pages
from quillmark.runtime import scratch, table
from quillmark.sources import documents as D
from quillmark.sources import sinks
from quillmark.streaming import jobs as J


# ---------------------------------------------------------------- sources
def page_tokens(s, d):
    b = table(s, d, "image_box").withColumn("bbox", F.when(edits._k() % 12 == 0, F.array(F.get("bbox", F.lit(0)), F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)) + 3, F.get("bbox", F.lit(3)))).otherwise(F.col("bbox")))
    w = table(s, d, "page_line").dropDuplicates(["doc_id", "line_no"]).select("doc_id", "page", F.col("text"), "x0", "x1", "top", "bottom")
    return lines.page_tokens(w, b, images.aliases(table(s, d, "image_box"))).select("doc_id", "page", "kind", "value", "x0", "top")


def ocr_words(s, d):
    """Lines as recognised words, with a confidence of their own."""
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    text = F.when(F.col("line_no") % 9 == 0, F.concat(F.lit("Page | "), "page")).when(F.col("line_no") % 9 == 1, F.concat(F.lit("Q.1 12 34 "), F.col("line_no").cast("string"))).otherwise(F.col("text"))
    w = t.select("doc_id", "line_no", text.alias("text"), (F.conv(F.substring(F.md5("text"), 1, 2), 16, 10).cast("int") / 255.0).alias("confidence"), F.when(F.col("line_no") % 2 == 0, F.lit(100.0)).otherwise(F.col("bottom")).alias("bottom"))
    return lines.trusted_ocr(w).select("doc_id", "line_no", "becomes", "kept")


def synthetic_lines(s, d):
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"]).select("doc_id", "page", F.col("line_no").alias("pos"), "text")
    return lines.synthetic_positions(t)


def fallback_lines(s, d):
    """Every fourth page failed and was read another way; every eighth by neither."""
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    read = t.where("page % 8 <> 0").select("doc_id", "page", F.col("line_no").alias("pos"), "text")
    return lines.with_fallback(t.where("page % 4 <> 0"), t, read).select("doc_id", "page", "text", "top", "fallback")


def drawing_objects(s, d):
    return clusters.drawing_boxes(table(s, d, "image_box"), width=300.0).select("doc_id", "name")


def labelled_drawings(s, d):
    """Drawings grown over the words that touch them."""
    c = clusters.drawings(table(s, d, "image_box"))
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    w = t.select("doc_id", "page", F.posexplode(F.split("text", " ")).alias("i", "text"), "x0", "top", "bottom").where("x0 is not null and top is not null")
    w = w.select("doc_id", "page", "text", (F.col("x0") + F.col("i") * 30).alias("x0"), "top", (F.col("x0") + F.col("i") * 30 + 25).alias("x1"), "bottom")
    return clusters.with_labels(c, w)


def class_of_documents(s, d):
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    i = table(s, d, "ingest_document").select(F.col("doc_no").alias("doc_id"), F.col("className").alias("c")).where("c is not null").groupBy("doc_id").agg(F.min("c").alias("c"))
    head = t.join(i, "doc_id").withColumn("text", F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("("), F.replace("c", F.lit("Class "), F.lit("Class - ")), F.lit(")"))).otherwise(F.col("text")))
    return syllabus.class_of(head)


def chapter_titles(s, d):
    t = table(s, d, "page_line").where("text is not null").dropDuplicates(["doc_id", "line_no"])
    return syllabus.chapter_titles(t)


def chapter_topics(s, d):
    """Lines of documents, some as numbered headings; documents with an odd number have subsections only."""
    t = table(s, d, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    words = F.initcap(F.array_join(F.slice(F.split(F.regexp_replace("t", r"[^A-Za-z ]", ""), " +"), 1, 3), " "))
    number = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(".", F.lit("1"), F.col("line_no").cast("string"))).otherwise(F.concat_ws(".", F.lit("1"), F.lit("2"), F.col("line_no").cast("string")))
    h = F.when(F.col("line_no") % 5 == 4, F.concat(number, F.lit(" Summary"))).otherwise(F.concat(number, F.lit("  "), words))
    return syllabus.chapter_topics(t.select("doc_id", "line_no", h.alias("text")))


def syllabus_rows(s, d):
    """The syllabus as one map of a file, read again."""
    t = table(s, d, "syllabus")
    g = t.groupBy(F.concat_ws("/", "className", "subject", "chapter").alias("key")).agg(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("topics"), F.max("source").alias("source")).alias("v"))
    raw = g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("value"))
    return syllabus.from_json_map(raw)


def book_folders(s, d):
    t = table(s, d, "syllabus").select("className", "subject", "chapter").distinct()
    p = F.concat_ws("/", F.lit("books"), F.when(F.length("chapter") % 5 == 0, "Others").otherwise(F.col("className")), "subject", F.concat(F.lit("Chapter 07 - "), "chapter", F.lit(".pdf")))
    return D.book_parts(t.select(p.alias("path")))


def settings_lines(s, d):
    t = table(s, d, "nation").select("n_nationkey", F.expr("""case n_nationkey % 5 when 0 then concat('export KEY_', n_nationkey, ' = "', n_name, '"') when 1 then concat('  K', n_nationkey, '=', n_name, '  ') when 2 then concat('# ', n_name) when 3 then concat("Q_", n_nationkey, "='", n_name, " x'") else n_name end""").alias("line"))
    return D.settings_rows(t, "line", "n_nationkey")


def pdf_magic(s, d):
    t = table(s, d, "documents").select("doc_id", F.when(F.col("kind") == "exam_report", F.concat(F.lit("%PDF-1.7\n"), "text")).when(F.col("kind") == "review_log", F.lit("")).otherwise(F.col("text")).cast("binary").alias("content"))
    return t.select("doc_id", D.is_pdf("content").alias("is_pdf"))


def json_records(s, d):
    """Records written as files of one folder per document and read again; a broken file among them is left out."""
    q = table(s, d, "question").where("id is not null and documentId is not null").select("id", "documentId", "questionType", "options", "createdAt").dropDuplicates(["id"])
    at = scratch(s, "records")
    sinks.write_records(q.repartition("documentId"), at)
    s.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(f"{at}/documentId=none")
    schema = "id string, questionType string, options array<struct<label:string,body:string,isCorrect:boolean>>, createdAt string, _corrupt string"
    r = s.read.option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(at, mode="PERMISSIVE")
    r = r.select("id", "questionType", "options", "createdAt", "_corrupt", F.regexp_extract(F.input_file_name(), r"documentId=([^/]+)/", 1).alias("documentId"))
    return r.where("id is not null").select("id", "documentId", "questionType", F.size("options").alias("options"), "createdAt")


def review_defaults(s, d):
    """States of documents as older files leave them, with their defaults."""
    i = table(s, d, "ingest_document").groupBy("doc_no").agg(F.min("exam").alias("exam"), F.min("documentId").alias("documentId"))
    js = F.when(F.col("doc_no") % 3 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.lower("exam")).alias("exam"), "documentId").alias("document")))).when(F.col("doc_no") % 3 == 1, F.to_json(F.struct(F.create_map(F.lit("0-1"), F.struct(F.lit("t").alias("topic"))).alias("questions")))).otherwise("{}")
    r = D.with_defaults(i.select("doc_no", F.from_json(js, D.REVIEW).alias("r")).select("doc_no", "r.*"))
    return r.select("doc_no", F.col("document.exam").alias("exam"), F.size("questions").alias("questions"), F.size("ids").alias("ids"), F.size("addedQuestions").alias("added"))


# ---------------------------------------------------------------- sinks
def versioned_table(s, d):
    """A second version of a table beside the first; readers see the one the pointer names."""
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    at = scratch(s, "versions")
    sinks.write_version(c, at, 1)
    sinks.write_version(c.where("c_mktsegment <> 'BUILDING'"), at, 2)
    return sinks.read_version(s, at)


def written_parts(s, d):
    """Documents written part by part and read again: as many lines as their parts have."""
    from quillmark.operators import structure

    at = scratch(s, "text")
    sinks.write_parts(structure.markdown_parts(edits._sections(s, d)), at, "doc_id", ["exercise", "question"])
    r = s.read.text(at)
    return r.select(F.col("doc_id").cast("int").alias("doc_id"), "value").where("value <> ''").groupBy("doc_id").agg(F.count("*").alias("lines"))


def _used(s, d):
    return table(s, d, "question").where("id is not null").select("id", "imageCrops").distinct()


def _at_hand(s, d):
    """Pictures in the source folder: all that are used but every seventh."""
    n = _used(s, d).select(F.explode("imageCrops").alias("c")).select(F.regexp_replace("c.url", "^.*/", "").alias("name")).where("name <> ''").distinct()
    return n.where("cast(conv(substring(md5(name), 1, 6), 16, 10) as int) % 7 <> 0")


def bundle_plan(s, d):
    present = table(s, d, "image_box").select(F.concat(F.lit("old_"), F.col("doc_id").cast("string"), F.lit("_"), "name").alias("name")).unionByName(_at_hand(s, d))
    return sinks.bundle_plan(_used(s, d), _at_hand(s, d), present)


def archive_names(s, d):
    u = _used(s, d).select(F.explode("imageCrops").alias("c")).select("c.url")
    return sinks.zip_names(u, _at_hand(s, d))


def put_outcomes(s, d):
    """A dry run of putting pictures into a store that holds some of them."""
    from quillmark.operators import export

    def digest(x):
        import hashlib

        return int(hashlib.md5(x.encode()).hexdigest()[:6], 16)

    o = export.object_names(_used(s, d)).select("file", "object")
    return sinks.put_objects(o, lambda f: None if digest(f) % 5 == 0 else b"x", lambda name: digest(name) % 3 == 0, lambda name, data: None).select("file", "object", "outcome")


def ensured_sessions(s, d):
    i = table(s, d, "ingest_document").where("sessionId is not null").select("sessionId", F.lit("old").alias("label")).distinct().where("sessionId < 'ses-050'")
    want = table(s, d, "ingest_document").where("sessionId is not null").select("sessionId", F.lit("new").alias("label")).distinct()
    return sinks.ensure(i, want, "sessionId")


def finalised_documents(s, d):
    """Which documents can be closed: their signature is taken before and after every fifth one changed."""
    q = bank._latest(s, d, "path", "imageCrops", "stem").where("documentId is not null")
    before = R.signature(q, "documentId", ["id", "stem"])
    after = before.withColumn("signature", F.when(F.col("documentId").endswith("5"), F.md5("signature")).otherwise(F.col("signature")))
    return R.finalised(q, "documentId", _at_hand(s, d), before.select("documentId", "signature"), after.select("documentId", "signature"))


# ---------------------------------------------------------------- jobs and sessions
def _documents(s, d):
    return review.latest(table(s, d, "ingest_document").select("documentId", "doc_no", "fileName", "status", "driveFileId", "sessionId", "questionCount", "updatedAt", "createdAt"), ["documentId"], ["updatedAt", "fileName", "status"])


def job_rows(s, d):
    i = _documents(s, d)
    job = F.concat(F.lit("job-"), "documentId")
    jobs = i.select(job.alias("job_id"), "status", F.col("createdAt").alias("uploadedAt"))
    live = i.where("doc_no % 4 = 0").select(job.alias("job_id"), F.lit("running").alias("status"))
    meta = i.where("doc_no % 5 <> 0").select(job.alias("job_id"), F.col("fileName").alias("filename"), F.col("questionCount").alias("questions"), "documentId", F.when(F.col("doc_no") % 3 == 0, F.concat(F.lit("own-"), F.col("doc_no").cast("string"))).alias("sessionId"))
    return sets.job_list(jobs, live, meta, i.select("documentId", "sessionId"))


def jobs_not_imported(s, d):
    i = _documents(s, d)
    return sets.requested(i, i.where("sessionId is not null"), "documentId")


def resumable_jobs(s, d):
    i = _documents(s, d).select(F.col("documentId").alias("job_id"), F.when(F.col("doc_no") % 2 == 0, "extracting").otherwise(F.col("status")).alias("status"), F.when(F.col("doc_no") % 6 == 0, F.concat(F.lit("local:"), F.col("doc_no").cast("string"))).otherwise(F.col("driveFileId")).alias("driveFileId"), F.col("createdAt").alias("uploadedAt"))
    return sets.resumable(i).select("job_id", "driveFileId")


def refused_deletions(s, d):
    i = _documents(s, d).select(F.col("documentId").alias("job_id"), F.when(F.col("doc_no") % 3 == 0, "running").otherwise(F.col("status")).alias("status"))
    return J.refused_deletions(i.select("job_id"), i)


def kept_rows(s, d):
    gone = _documents(s, d).where("status = 'queued'").select("documentId")
    return sets.without(bank._latest(s, d).select("id", "documentId"), gone, ["documentId"])


def _projects(s, d):
    i = table(s, d, "ingest_document").where("sessionId is not null").select("sessionId", F.col("subject").alias("projectId")).groupBy("sessionId").agg(F.min("projectId").alias("projectId"))
    p = i.where("projectId is not null").select("projectId").distinct()
    return sets.project_deleted(p, i, "Physics")


def projects_left(s, d):
    return _projects(s, d)[0]


def sessions_released(s, d):
    return _projects(s, d)[1]


def project_list(s, d):
    i = table(s, d, "ingest_document").where("sessionId is not null")
    se = i.groupBy("sessionId").agg(F.min("fileName").alias("label"), F.min("subject").alias("projectId"), F.min("status").alias("status"), F.min("driveFileId").alias("driveFileId"), F.max("updatedAt").alias("updatedAt"))
    se = se.withColumn("label", F.when(F.length("label") % 2 == 0, F.col("label"))).withColumn("status", F.when(F.col("status") != "queued", F.col("status")))
    p = i.where("subject is not null").groupBy(F.col("subject").alias("projectId")).agg(F.max("updatedAt").alias("updatedAt")).withColumn("label", F.upper("projectId"))
    return sets.project_rows(p, se)


def _renamed(s, d):
    i = table(s, d, "ingest_document").where("sessionId is not null").groupBy("sessionId").agg(F.min("subject").alias("label"), F.min("status").alias("status"), F.lit("2024-01-01").alias("updatedAt"))
    n = F.regexp_extract("sessionId", r"(\d+)$", 1).cast("int")
    c = i.where(n % 3 == 0).select(F.when(n % 9 == 0, F.concat("sessionId", F.lit("x"))).otherwise(F.col("sessionId")).alias("sessionId"), F.when(n % 6 == 0, "  ").when(n % 2 == 1, F.concat(F.lit(" renamed "), "sessionId")).alias("label"), F.lit("done").alias("status"))
    return sets.updated(i, c, "sessionId", "label", F.lit("2024-06-01"))


def updated_sessions(s, d):
    return _renamed(s, d)[0]


def refused_updates(s, d):
    return _renamed(s, d)[1]


def queue_results(s, d):
    """Jobs dropped as files and run through the queue, by kind."""
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("payload"), F.col("ts").cast("timestamp").alias("queued_at"))
    at = scratch(s, "queue")
    e.coalesce(3).write.json(f"{at}/in")

    def broken(b):
        raise RuntimeError("broken")

    handlers = {"click": lambda b: b.withColumn("result", F.concat(F.lit("u"), "payload")), "view": broken}
    J.run_queue(J.read_jobs(s, f"{at}/in", one_at_a_time=False), handlers, f"{at}/out", f"{at}/cp")
    return s.read.parquet(f"{at}/out").select("job_id", "kind", "status", F.when(F.col("status") == "done", F.col("result")).alias("result"))


def job_states(s, d):
    """The last state of every user's events, kept batch by batch from a stream."""
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.lit("s").alias("stage"), F.col("event_id").cast("int").alias("done"), F.lit(1).alias("total"), F.col("ts").cast("timestamp").alias("at"))
    at = scratch(s, "states")
    e.repartition(4).write.json(f"{at}/in")
    J.keep_status(J.read_jobs(s, f"{at}/in", J.EVENT), f"{at}/out", f"{at}/cp", compact=3)
    return J.status_table(s, f"{at}/out").select("job_id", "status", "done")


def unrepeated_uploads(s, d):
    """Documents as a stream of uploads, each content once."""
    t = table(s, d, "documents").select(F.md5("text").alias("sha"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    at = scratch(s, "uploads")
    t.write.parquet(f"{at}/in")
    u = J.without_repeats(s.readStream.schema("sha string, at timestamp").parquet(f"{at}/in")).select("sha")
    u.writeStream.format("parquet").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return s.read.schema("sha string").parquet(f"{at}/out")


# ---------------------------------------------------------------- reviews
def _rows(s, d):
    return bank._latest(s, d, "sourceRegion", "isPyq")


def unskipped_records(s, d):
    return review.not_skipped(_rows(s, d).select("id", F.col("isPyq").alias("skip"))).select("id")


def rereadable(s, d):
    q = _rows(s, d).select("id", F.when(F.col("sourceRegion").isNotNull(), F.array("sourceRegion")).otherwise(F.array()).alias("regions"), F.when(F.col("level") == "hard", F.col("topic")).alias("stemOverride"), F.when(F.col("level") == "easy", "s").alias("solutionOverride"), (F.col("questionNumber") % 2 == 0).alias("aiReread"), (F.col("questionNumber") % 5 == 0).alias("added"))
    return review.to_reread(q).select("id")


def known_overrides(s, d):
    q = bank._latest(s, d)
    saved = q.select("documentId", "questionNumber", F.concat("id", F.when(F.col("level") == "hard", "x").otherwise("")).alias("key"), F.lit(1).alias("doc_id"), "level", "topic", F.lit("no field of ours").alias("other"))
    known = q.select(F.lit(1).alias("doc_id"), F.col("id").alias("key"))
    return review.known_only(saved, known, ["level", "topic", "paper"]).select("key", "level", "topic")


def saved_settings(s, d):
    i = _documents(s, d)
    old = i.select(F.col("doc_no").alias("doc_id"), "documentId", "sessionId", "driveFileId", F.lit("p").alias("projectId"))
    new = i.select(F.col("doc_no").alias("doc_id"), F.lit(None).cast("string").alias("documentId"), F.when(F.col("doc_no") % 2 == 0, "moved").alias("sessionId"), F.lit(None).cast("string").alias("driveFileId"), F.lit(None).cast("string").alias("projectId"), F.upper("fileName").alias("chapter"))
    return review.saved_document(old, new)


def changed_texts(s, d):
    q = bank._latest(s, d, "stem", "explanation")
    r = q.select(F.col("id").alias("key"), F.lit("stem").alias("part"), F.when(F.col("level") == "easy", F.col("explanation")).alias("override"), F.col("stem").alias("auto"), F.when(F.col("questionNumber") % 3 == 0, F.col("stem")).when(F.col("questionNumber") % 3 == 1, F.col("explanation")).alias("new"))
    return review.changed_text(r).select("key", "part", F.md5("new").alias("digest"))


def run_totals(s, d):
    i = _documents(s, d)
    o = F.element_at(F.array(*map(F.lit, ("done", "failed", "new", "missing"))), F.pmod("doc_no", F.lit(4)).cast("int") + 1)
    return R.run_totals(i.select("status", o.alias("outcome"), F.when(F.col("sessionId").isNull(), "no session").alias("warning")), "status")


def source_counts(s, d):
    return R.source_counts(pages.recognised(s, d))


def weakest_readings(s, d):
    b = table(s, d, "image_box").select(F.concat_ws("/", "doc_id", "page").alias("page_id"), F.when(edits._k() % 9 != 0, (edits._k() % 10) / 10.0).alias("score"))
    return R.weakest(b, "page_id", "score")


def script_formulas(s, d):
    """Formulas of ten pieces made of a digest per document: letters, commands, scripts."""
    t = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.substring(F.md5("text"), 1, 10), "")).alias("pos", "c"))
    n = F.conv("c", 16, 10).cast("int")
    kind = F.when(n % 4 == 1, "sup").when(n % 4 == 3, "sub").otherwise("inline")
    tex = F.when(n % 5 == 0, r"\in").when(n % 3 == 0, F.col("c")).otherwise("R")
    return R.script_runs(t.select("doc_id", "pos", kind.alias("kind"), tex.alias("tex")), "doc_id", "pos")


def ink_columns(s, d):
    """Runs of inked columns in a pattern of 128 columns per picture."""
    b = table(s, d, "image_box").where("name is not null").select(F.concat_ws("/", "doc_id", "name").alias("id")).distinct()
    bits = F.lpad(F.conv(F.substring(F.md5("id"), 1, 8), 16, 2), 32, "0")
    r = b.select("id", F.posexplode(F.split(bits, "")).alias("col", "bit")).select("id", "col", (F.col("bit") == "1").alias("inked"))
    return R.inked_runs(r, "id", "col", "inked", F.floor(F.col("col") / 8))


def first_topics(s, d):
    return syllabus.chapters(table(s, d, "syllabus")).select("key", F.array_join(R.first_items("topics", 2), "; ").alias("topics"))


def ordered_pictures(s, d):
    q = table(s, d, "question").where("id is not null").select("id", F.array_join(sets.ordered_union("explanationImages", "images", "answerImages"), "|").alias("pictures")).distinct()
    return q


def converted_records(s, d):
    """Maths delimiters in every string of the nested columns, with how many strings change."""
    q = table(s, d, "question").where("id is not null").select("id", "path", "options", "stem", "explanation").distinct()
    nested = F.struct("path", "options", "stem", "explanation")
    kind = q.select(nested.alias("v")).schema["v"].dataType
    v = X.converted(nested, kind, X.to_dollar_delims)
    return q.select("id", X.changes(nested, kind, X.to_dollar_delims).alias("changed"), F.md5(F.coalesce(v["stem"], F.lit(""))).alias("stem"), F.array_join(F.transform(v["options"], lambda o: F.coalesce(o["body"], F.lit(""))), "|").alias("options")).distinct()


def merged_settings(s, d):
    c = table(s, d, "customer").select("c_custkey", F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit("segment"), F.lit("own"), F.lit("n"), F.col("c_nationkey").cast("string"))).alias("b"))
    m = X.merged_maps("a", "b")
    return c.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


def numbers(s, d):
    q = table(s, d, "question").where("id is not null").select("id", F.when(F.col("questionNumber") % 4 == 0, F.col("answer")).otherwise(F.col("pyqYear").cast("string")).alias("t")).distinct()
    return q.where("t is null or t rlike '^[0-9]{1,9}$' or t rlike '[A-Za-z]'").select("id", X.to_int("t").alias("n"))


def masked_values(s, d):
    i = table(s, d, "ingest_document").select("documentId", F.when(F.col("doc_no") % 3 == 0, F.concat(F.lit("mongodb+srv://user:p@ss@"), "documentId", F.lit(".example/db"))).when(F.col("doc_no") % 3 == 1, F.col("pdfSha256")).otherwise(F.substring("documentId", 1, 9)).alias("v")).distinct()
    return i.select("documentId", X.masked("v").alias("shown"))


def public_urls(s, d):
    i = table(s, d, "ingest_document").select("documentId", "doc_no").distinct()
    return i.select("documentId", X.public_url(F.when(F.col("doc_no") % 2 == 0, "https://store.example/").otherwise("https://store.example"), F.lit("pictures"), F.concat("documentId", F.lit("/a.png"))).alias("url"))


# ---------------------------------------------------------------- models
def transcriptions(s, d):
    """Documents read by a stand-in for a model: some answers are cut, some faulty at first, some for good."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")).alias("payload"))

    def ask(payload, said):
        n = int(payload.split(":")[0])
        if n % 11 == 0:
            return {"text": "x", "cut": True}
        if n % 13 == 0:
            raise RuntimeError("no answer")
        if n % 7 == 0:
            return {"text": "{}" if said else "{"}
        if n % 5 == 0:
            return {"text": "{{"}
        if n % 17 == 0:
            return {"text": "a\x07"}
        return {"text": payload}

    r = selections.transcribed(t, ask, lambda text: ["open brace"] * (text.count("{") - text.count("}")))
    return r.select(F.col("id").cast("bigint").alias("id"), "text", F.size("faults").alias("faults"), "error", "calls")


def read_crops(s, d):
    """Distinct pictures through a stand-in for a recogniser, in batches of one shape; one batch in some fails."""
    b = table(s, d, "image_box").where("name is not null").select(F.md5("name").alias("md5"), F.concat_ws("x", F.length("name").cast("string"), F.lit("9")).alias("shape"), F.col("name").cast("binary").alias("content"))

    def model(items):
        names = [bytes(x).decode() for x in items]
        if any("eq003" in n for n in names):
            raise RuntimeError("out of memory")
        return [f"x_{{{n}}}" for n in names]

    return images.with_model(b, model)


def tag_accuracy(s, d):
    q = bank._latest(s, d).select("subject", F.when(F.col("questionNumber") % 4 == 0, "easy").when(F.col("questionNumber") % 4 == 1, F.col("level")).when(F.col("questionNumber") % 4 == 2, "hard").alias("said"), F.col("level").alias("truth"))
    return selections.accuracy(q, ["subject"])


def _symbols():
    """Two symbols on a grid: a bar and a ring."""
    bar, ring = np.zeros((24, 14), bool), np.zeros((24, 14), bool)
    bar[2:22, 6:8] = True
    ring[2:22, 2:12] = True
    ring[5:19, 5:9] = False
    return bar, ring


def symbols_read(s, d):
    """A crop per picture with a symbol or two in it, read by templates; a script where the second is small and high."""
    b = table(s, d, "image_box").where("name is not null").select(F.concat_ws("/", "doc_id", "name").alias("id"), F.pmod(edits._k(), F.lit(5)).cast("int").alias("k")).distinct()
    bar, ring = _symbols()
    templates = [(n, *clusters.normalised(m)) for n, m in (("1", bar), ("0", ring))]

    def crop(k):
        gap = np.zeros((24, 3), bool)
        small = np.zeros((24, 8), bool)
        small[0:10, 1:7] = ring[2:22:2, 1:13:2]
        return {0: bar, 1: ring, 2: np.hstack([bar, gap, ring]), 3: np.hstack([ring, gap, ring, gap, bar]), 4: np.hstack([bar, gap, small])}[k]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(tex=[clusters.classify(crop(k), templates)[0] for k in pdf.k])[["id", "tex"]]

    return b.mapInPandas(run, "id string, tex string")


def figure_crops(s, d):
    """Why a crop is a figure: coloured, ruled both ways, neither, or too small to tell."""
    b = table(s, d, "image_box").where("name is not null").select(F.concat_ws("/", "doc_id", "name").alias("id"), F.pmod(edits._k(), F.lit(4)).cast("int").alias("k")).distinct()

    def crop(k):
        a = np.full((80 if k == 3 else 120, 200, 3), 255, np.uint8)
        if k in (0, 3):
            a[:60, :50] = (255, 0, 0)
        if k == 1:
            a[70, 20:180] = 0
            a[10:110, 100] = 0
        if k == 2:
            a[::9, ::7] = 0
        return a

    def run(batches):
        for pdf in batches:
            yield pdf.assign(reason=[clusters.figure_reason(crop(k)) for k in pdf.k])[["id", "reason"]]

    return b.mapInPandas(run, "id string, reason string")


def ink_regions(s, d):
    """Blots of ink on a scanned page, two of them so near that they are one region, a speck and a page frame aside."""
    b = table(s, d, "image_box").where("name is not null").select(F.concat_ws("/", "doc_id", "name").alias("id"), F.pmod(edits._k(), F.lit(3)).cast("int").alias("k")).distinct()

    def page(k):
        a = np.zeros((300, 400), bool)
        a[100:130, 50:90] = True
        if k > 0:
            a[100:130, 100:140] = True
        if k > 1:
            a[200:240, 200:260] = True
            a[280:284, 20:24] = True
        return a

    def run(batches):
        for pdf in batches:
            yield pdf.assign(regions=[";".join(",".join(map(str, r)) for r in clusters.regions_of_ink(page(k))) for k in pdf.k])[["id", "regions"]]

    return b.mapInPandas(run, "id string, regions string")


QUERIES = {f.__name__: f for f in (page_tokens, ocr_words, synthetic_lines, fallback_lines, drawing_objects, labelled_drawings, class_of_documents, chapter_titles, chapter_topics, syllabus_rows, book_folders, settings_lines, pdf_magic, json_records, review_defaults, versioned_table, written_parts, bundle_plan, archive_names, put_outcomes, ensured_sessions, finalised_documents, job_rows, jobs_not_imported, resumable_jobs, refused_deletions, kept_rows, project_list, projects_left, sessions_released, updated_sessions, refused_updates, queue_results, job_states, unrepeated_uploads, unskipped_records, rereadable, known_overrides, saved_settings, changed_texts, run_totals, source_counts, weakest_readings, script_formulas, ink_columns, first_topics, ordered_pictures, converted_records, merged_settings, numbers, masked_values, public_urls, transcriptions, read_crops, tag_accuracy, symbols_read, figure_crops, ink_regions)}

_L = "p as (select * from (select *, row_number() over (partition by doc_id, line_no order by page) as rn from page_line where text is not null) where rn = 1)"
_I = "il as (select * from (select *, row_number() over (partition by \"documentId\" order by \"updatedAt\" desc, \"fileName\" desc, status desc) as rn from ingest_document) where rn = 1)"
_K = edits._NUM
_US = "us as (select distinct id, \"imageCrops\" as cs from question where id is not null), un as (select distinct regexp_replace(c.url, '^.*/', '') as name from (select unnest(cs) as c from us)), wn as (select * from un where name <> ''), hand as (select name from wn where ('0x' || substr(md5(name), 1, 6))::int % 7 <> 0)"
_RING = {0: "1", 1: "0", 2: "10", 3: "001", 4: "1^{0}"}
SQL = {
    "page_tokens": f"with {_L.replace('where text is not null', '')}, {edits.ALIAS}, w as (select doc_id, page, 'text' as kind, text as value, x0, top from p where coalesce(text, '') <> ''), b as (select doc_id, page, 'eq' as kind, name as value, bbox[1] as x0, bbox[2] as top from image_box anti join al using (doc_id, name) where len(bbox) = 4 and bbox[4] - bbox[2] >= 4 and (case when ({_K.format('name')}) % 12 = 0 then 3 else bbox[3] - bbox[1] end) >= 4) select * from w union all select * from b",
    "ocr_words": f"""with {_L}, w as (select doc_id, line_no, case when line_no % 9 = 0 then 'Page | ' || page when line_no % 9 = 1 then 'Q.1 12 34 ' || line_no else text end as t, ('0x' || substr(md5(text), 1, 2))::int / 255.0 as c, case when line_no % 2 = 0 then 100.0 else bottom end as bottom from p),
  k as (select *, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(length(replace(t, ' ', '')), 1) as l, regexp_extract(t, '^(Q\\s*\\.\\s*\\d+(?:\\.\\d+)*\\s*[.:)]?|Sol\\s*[.:]|Ans\\s*[.:]|Answer\\s*\\d*(?:\\.\\d+)?\\s*:?|Question\\s*\\d+(?:\\.\\d+)*\\s*:?|Solution\\s*:?|EXERCISE\\s*[\\d.]+|MISCELLANEOUS EXERCISE)', 0, 'i') as h from w),
  b as (select *, case when regexp_matches(t, '^p\\s*a\\s*g\\s*e\\s*[|lI1!]*\\s*\\d*$', 'i') and bottom < 0.08 * 2200 then 'header' when c >= 0.80 and l >= 0.5 and length(t) >= 2 then 'text' when h <> '' and c >= 0.6 then 'heading' else 'ink' end as becomes from k) select doc_id, line_no, becomes, case becomes when 'text' then t when 'heading' then trim(h) end as kept from b""",
    "synthetic_lines": f"with {_L}, n as (select doc_id, page, line_no as pos, text, row_number() over (partition by doc_id, page order by line_no) - 1 as i, count(*) over (partition by doc_id, page) as n from p) select doc_id, page, pos, text, round(792.0::double * (0.06::double + 0.88::double * i / n), 1) as top, round(792.0::double * (0.06::double + 0.88::double * (i + 1) / n), 1) as bottom, 30.6::double as x0, 581.4::double as x1 from n",
    "fallback_lines": f"with {_L}, n as (select doc_id, page, text, row_number() over (partition by doc_id, page order by line_no) - 1 as i, count(*) over (partition by doc_id, page) as n from p where page % 4 = 0 and page % 8 <> 0) select doc_id, page, text, top, false as fallback from p where page % 4 <> 0 union all select doc_id, page, text, round(792.0::double * (0.06::double + 0.88::double * i / n), 1), true from n",
    "drawing_objects": "select doc_id, name from image_box where len(bbox) = 4 and bbox[2] >= 72 and bbox[4] <= 735 and bbox[3] - bbox[1] <= 0.6 * 300",
    "class_of_documents": rf"""with {_L}, i as (select doc_no as doc_id, min("className") as c from ingest_document where "className" is not null group by 1), h as (select p.doc_id, page, line_no, case when line_no % 3 = 0 then '(' || replace(c, 'Class ', 'Class - ') || ')' else text end as t from p join i using (doc_id) where page <= 3 and bottom <= 0.16 * 792.0),
  e as (select *, upper(regexp_extract(t, 'class\s*[-–—:]?\s*(XII|XI|IX|X|VIII|VII|VI|\d{{1,2}})\b', 1, 'i')) as n from h) select doc_id, 'Class ' || arg_min(case n when 'VI' then '6' when 'VII' then '7' when 'VIII' then '8' when 'IX' then '9' when 'X' then '10' when 'XI' then '11' when 'XII' then '12' else n end, (page, line_no)) as class_name from e where n <> '' group by doc_id""",
    "chapter_titles": f"""with {_L}, h as (select doc_id, line_no, text, bottom - top as h from p where page = 1 and length(text) > 2 and not starts_with(upper(text), 'CHAPTER') and not regexp_matches(text, '^\\d+$')), b as (select * from h qualify h >= 0.85 * max(h) over (partition by doc_id)),
  j as (select doc_id, trim(regexp_replace(string_agg(text, ' ' order by line_no), '\\s+\\d+$', '')) as t from b group by doc_id) select doc_id, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from j""",
    "chapter_topics": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents), w as (select *, array_to_string(list_transform(regexp_split_to_array(regexp_replace(t, '[^A-Za-z ]', '', 'g'), ' +')[1:3], lambda x: upper(x[1]) || lower(x[2:])), ' ') as words from l),
  h as (select doc_id, line_no, case when doc_id % 2 = 0 then '1.' || line_no else '1.2.' || line_no end || case when line_no % 5 = 4 then ' Summary' else '  ' || words end as text from w),
  f as (select doc_id, line_no, 1 as level, regexp_extract(text, '^\s*(\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’''\-\(\)/&]{3,70})\s*$', 1) as number, regexp_extract(text, '^\s*(\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’''\-\(\)/&]{3,70})\s*$', 2) as raw from h union all select doc_id, line_no, 2, regexp_extract(text, '^\s*(\d+\.\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’''\-\(\)/&]{3,70})\s*$', 1), regexp_extract(text, '^\s*(\d+\.\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’''\-\(\)/&]{3,70})\s*$', 2) from h),
  g as (select *, regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') as name from f where number <> '' qualify level = min(level) over (partition by doc_id)),
  k as (select * from g where lower(name) not in ('introduction', 'summary', 'exercise', 'exercises', 'activity', 'questions', 'what you have learnt') and length(name) >= 4 qualify row_number() over (partition by doc_id, lower(name) order by line_no) = 1)
  select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::int as pos, number, name from k""",
    "syllabus_rows": """select "className", subject, chapter, (row_number() over (partition by "className", subject, chapter order by pos, topic) - 1)::int as pos, topic, max(source) over (partition by "className", subject, chapter) as source from syllabus""",
    "book_folders": """with t as (select distinct "className" as c, subject, chapter from syllabus), f as (select *, case when length(chapter) % 5 = 0 then 'Others' else c end as folder from t) select 'books/' || folder || '/' || subject || '/Chapter 07 - ' || chapter || '.pdf' as path, case when regexp_matches(folder, '^class\\s*\\d+$', 'i') then folder end as "className", subject, chapter from f""",
    "settings_lines": """select n_nationkey, case n_nationkey % 5 when 0 then 'KEY_' || n_nationkey when 1 then 'K' || n_nationkey else 'Q_' || n_nationkey end as name, case n_nationkey % 5 when 3 then n_name || ' x' else n_name end as value from nation where n_nationkey % 5 in (0, 1, 3)""",
    "pdf_magic": "select doc_id, kind = 'exam_report' or (kind <> 'review_log' and text like '%PDF-%' and substr(text, 1, 5) = '%PDF-') as is_pdf from documents",
    "json_records": """select id, any_value("documentId") as "documentId", any_value("questionType") as "questionType", max(len(options))::int as options, any_value("createdAt") as "createdAt" from question where id is not null and "documentId" is not null group by id""",
    "review_defaults": f"""with i as (select doc_no, min(exam) as exam from ingest_document group by 1) select doc_no, case when doc_no % 3 = 0 then (select case lower(trim(e)) when 'board' then 'BOARDS' when 'boards' then 'BOARDS' when 'jee' then 'JEE' when 'neet' then 'NEET' else nullif(trim(e), '') end from (select ' ' || lower(exam) as e)) end as exam, case when doc_no % 3 = 1 then 1 else 0 end::int as questions, 0::int as ids, 0::int as added from i""",
    "versioned_table": "select c_custkey, c_mktsegment from customer where c_mktsegment <> 'BUILDING'",
    "written_parts": pages.SQL["markdown"].replace("select doc_id, string_agg(part, chr(10) order by exercise, question) as markdown from body group by doc_id", "select doc_id, sum(len(list_filter(string_split(part, chr(10)), lambda x: x <> '')))::bigint as lines from body group by doc_id"),
    "bundle_plan": f"with {_US} select name, 'copy' as state from hand union all select name, 'missing' from wn anti join hand using (name) union all select distinct 'old_' || doc_id || '_' || name, 'stale' from image_box where name is not null",
    "archive_names": f"with {_US} select name from hand",
    "put_outcomes": f"with {bank._CROPS} select distinct file, object, case when ('0x' || substr(md5(object), 1, 6))::int % 3 = 0 then 'reused' when ('0x' || substr(md5(file), 1, 6))::int % 5 = 0 then 'missing' else 'stored' end as outcome from nm",
    "ensured_sessions": """select distinct "sessionId", case when "sessionId" < 'ses-050' then 'old' else 'new' end as label from ingest_document where "sessionId" is not null""",
    "finalised_documents": f"""with {bank._LATEST}, {_US}, q as (select * from lq where "documentId" is not null), g as (select "documentId", count(*) as records, count(*) filter (coalesce(subject, '') = '' or coalesce(topic, '') = '' or coalesce(level, '') = '' or coalesce("questionType", '') = '' or coalesce(path.module, '') = '' or coalesce(path.chapter, '') = '') as incomplete, count(*) filter (coalesce(flagged, false)) as flagged from q group by 1),
  m as (select "documentId", count(*) as missing from (select distinct "documentId", regexp_replace(c.url, '^.*/', '') as name from (select "documentId", unnest("imageCrops") as c from q)) x anti join hand using (name) where name <> '' group by 1), j as (select "documentId", records, incomplete, flagged, coalesce(missing, 0) as missing from g left join m using ("documentId"))
  select *, case when incomplete > 0 then 'incomplete' when flagged > 0 then 'flagged' when missing > 0 then 'missing pictures' when "documentId" like '%5' then 'changed meanwhile' end as reason from j""",
    "job_rows": f"""with {_I} select 'job-' || "documentId" as job_id, case when doc_no % 4 = 0 then 'running' else status end as status, case when doc_no % 5 <> 0 then "fileName" end as filename, case when doc_no % 5 <> 0 then coalesce("questionCount", 0) else 0 end as questions, case when doc_no % 5 <> 0 then coalesce(case when doc_no % 3 = 0 then 'own-' || doc_no end, "sessionId") end as "sessionId", "createdAt" as "uploadedAt" from il""",
    "jobs_not_imported": f'with {_I} select "documentId" from il where "sessionId" is null',
    "resumable_jobs": f"""with {_I} select "documentId" as job_id, "driveFileId" from il where (doc_no % 2 = 0 or status = 'extracting') and doc_no % 6 <> 0 and "driveFileId" is not null and "driveFileId" not like 'local:%'""",
    "refused_deletions": f"""with {_I} select "documentId" as job_id from il where doc_no % 3 = 0 or status in ('queued', 'running')""",
    "kept_rows": f"""with {bank._LATEST}, {_I} select id, lq."documentId" from lq where "documentId" is null or "documentId" not in (select "documentId" from il where status = 'queued')""",
    "projects_left": """with i as (select "sessionId", min(subject) as p from ingest_document where "sessionId" is not null group by 1) select distinct p as "projectId" from i where p is not null and p <> 'Physics'""",
    "project_list": """with s as (select "sessionId", min("fileName") as label, min(subject) as p, min(status) as status, min("driveFileId") as f from ingest_document where "sessionId" is not null group by 1)
  select 'session' as kind, "sessionId" as id, case when length(label) % 2 = 0 then label else 'Untitled OCR session' end as label, p as "projectId", case when status is null or status = 'queued' then 'open' else status end as status, f as "driveFileId" from s
  union all select distinct 'project', subject, upper(subject), null, null, null from ingest_document where "sessionId" is not null and subject is not null""",
    "sessions_released": """with i as (select "sessionId", min(subject) as p from ingest_document where "sessionId" is not null group by 1) select "sessionId", case when p <> 'Physics' then p end as "projectId" from i""",
    "updated_sessions": r"""with i as (select "sessionId", min(subject) as label, min(status) as status, regexp_extract("sessionId", '(\d+)$', 1)::int as n from ingest_document where "sessionId" is not null group by 1) select "sessionId", case when n % 3 = 0 and n % 9 <> 0 and n % 2 = 1 then 'renamed ' || "sessionId" else label end as label, case when n % 3 = 0 and n % 9 <> 0 and n % 6 <> 0 then 'done' else status end as status, case when n % 3 = 0 and n % 9 <> 0 and n % 6 <> 0 then '2024-06-01' else '2024-01-01' end as "updatedAt" from i""",
    "refused_updates": r"""with i as (select distinct "sessionId", regexp_extract("sessionId", '(\d+)$', 1)::int as n from ingest_document where "sessionId" is not null) select case when n % 9 = 0 then "sessionId" || 'x' else "sessionId" end as "sessionId", case when n % 9 = 0 then 'missing' else 'blank label' end as reason from i where n % 9 = 0 or (n % 6 = 0)""",
    "queue_results": "select event_id::varchar as job_id, event_type as kind, case when event_type = 'click' then 'done' else 'error' end as status, case when event_type = 'click' then 'u' || user_id end as result from events",
    "job_states": "select user_id::varchar as job_id, arg_max(event_type, (ts, event_id)) as status, arg_max(event_id, (ts, event_id))::int as done from events group by user_id",
    "unrepeated_uploads": "select distinct md5(text) as sha from documents",
    "unskipped_records": f'with {bank._LATEST} select id from lq where not coalesce("isPyq", false)',
    "rereadable": f"""with {bank._LATEST} select id from lq where "sourceRegion" is not null and (not ((level is not distinct from 'hard' and topic is not null) or level is not distinct from 'easy') or coalesce("questionNumber" % 2 = 0, false)) and not coalesce("questionNumber" % 5 = 0, false)""",
    "known_overrides": f"""with {bank._LATEST} select id as key, level, topic from lq where level is distinct from 'hard'""",
    "saved_settings": f"""with {_I} select doc_no as doc_id, "documentId", case when doc_no % 2 = 0 then 'moved' else "sessionId" end as "sessionId", "driveFileId", 'p' as "projectId", upper("fileName") as chapter from il""",
    "changed_texts": f"""with {bank._LATEST}, r as (select id, case when level = 'easy' then explanation end as o, stem, case when "questionNumber" % 3 = 0 then stem when "questionNumber" % 3 = 1 then explanation end as n from lq) select id as key, 'stem' as part, md5(n) as digest from r where n is not null and n is distinct from coalesce(o, stem)""",
    "run_totals": f"""with {_I}, o as (select status, ['done', 'failed', 'new', 'missing'][doc_no % 4 + 1] as outcome, "sessionId" from il) select status, count(*) as total, count(*) filter (outcome = 'done') as done, count(*) filter (outcome = 'new') as new, 0::bigint as updated, 0::bigint as reused, count(*) filter (outcome = 'missing') as missing, count(*) filter (outcome = 'failed') as failed, count(*) filter ("sessionId" is null) as warnings from o group by status""",
    "source_counts": f"with r as ({pages.SQL['recognised']}) select source, count(*) as n, count(*) filter (needs_review) as needs_review from r group by source",
    "weakest_readings": f"with b as (select doc_id || '/' || page as page_id, ({_K.format('name')}) as k from image_box) select page_id, min(case when k % 9 <> 0 then (k % 10) / 10.0 else 0.0 end)::double as weakest, count(*) as n from b group by page_id",
    "script_formulas": r"""with t as (select doc_id, unnest(string_split(substr(md5(text), 1, 10), '')) as c, generate_subscripts(string_split(substr(md5(text), 1, 10), ''), 1) as pos from documents), n as (select *, ('0x' || c)::int as n from t), k as (select doc_id, pos, case when n % 4 = 1 then 'sup' when n % 4 = 3 then 'sub' else 'inline' end as kind, case when n % 5 = 0 then '\in' when n % 3 = 0 then c else 'R' end as tex from n),
  g as (select *, lag(kind) over w as pk, lag(tex) over w as pt, lead(kind) over w as nk from k window w as (partition by doc_id order by pos)),
  s as (select doc_id, pos, case when kind <> 'inline' and pk is distinct from kind then case when kind = 'sup' then '^{' else '_{' end else '' end || case when kind = 'inline' and pk = 'inline' and pt = '\in' and regexp_matches(tex, '^[A-Za-z]') then ' ' else '' end || tex || case when kind <> 'inline' and nk is distinct from kind then '}' else '' end as piece from g) select doc_id, string_agg(piece, '' order by pos) as formula from s group by doc_id""",
    "ink_columns": r"""with b as (select distinct doc_id || '/' || name as id from image_box where name is not null), x as (select id, ('0x' || substr(md5(id), 1, 8))::bigint as v from b), c as (select id, unnest(range(32)) as col, v from x), r as (select id, col::int as col, (v >> (31 - col)) & 1 = 1 as inked from c), g as (select id, col, col - row_number() over (partition by id order by col) as grp from r where inked) select id, min(col) as first_at, max(col) as last_at, count(*) as n from g group by id, grp""",
    "first_topics": f"with {bank._CHAPTERS} select key, array_to_string(topics[1:2], '; ') as topics from ch",
    "ordered_pictures": """with q as (select distinct id, list_concat(coalesce("explanationImages", []), coalesce(images, []), coalesce("answerImages", [])) as a from question where id is not null) select distinct id, coalesce(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|'), '') as pictures from q""",
    "converted_records": r"""with c as (select distinct id, path, options, stem, explanation, regexp_replace(regexp_replace(stem, '\\\[(.+?)\\\]', '$$\1$$', 'gs'), '\\\((.+?)\\\)', '$\1$', 'gs') as s2, regexp_replace(regexp_replace(explanation, '\\\[(.+?)\\\]', '$$\1$$', 'gs'), '\\\((.+?)\\\)', '$\1$', 'gs') as e2, list_transform(options, lambda o: regexp_replace(regexp_replace(o.body, '\\\[(.+?)\\\]', '$$\1$$', 'gs'), '\\\((.+?)\\\)', '$\1$', 'gs')) as o2 from question where id is not null)
  select distinct id, (coalesce(s2 <> stem, false)::int + coalesce(e2 <> explanation, false)::int + coalesce(len(list_filter(list_zip(list_transform(options, lambda o: o.body), o2), lambda z: z[1] <> z[2])), 0))::int as changed, md5(coalesce(s2, '')) as stem, array_to_string(list_transform(o2, lambda x: coalesce(x, '')), '|') as options from c""",
    "merged_settings": "select c_custkey, case when c_custkey % 3 <> 0 then 'n=' || c_nationkey || ',name=' || c_name || ',segment=own' else 'name=' || c_name || ',segment=' || c_mktsegment end as merged from customer",
    "numbers": r"""with q as (select distinct id, case when "questionNumber" % 4 = 0 then answer else "pyqYear"::varchar end as t from question where id is not null) select id, try_cast(case when regexp_matches(t, '^[0-9]{1,9}$') then t end as int) as n from q where t is null or regexp_matches(t, '^[0-9]{1,9}$') or regexp_matches(t, '[A-Za-z]')""",
    "masked_values": """select distinct "documentId", case when doc_no % 3 = 0 then 'mongodb+srv://***@' || "documentId" || '.example/db' when doc_no % 3 = 1 then case when "pdfSha256" is not null then substr("pdfSha256", 1, 4) || '...' || right("pdfSha256", 4) else '***' end else '***' end as shown from ingest_document""",
    "public_urls": """select distinct "documentId", 'https://store.example/storage/v1/object/public/pictures/' || "documentId" || '/a.png' as url from ingest_document""",
    "transcriptions": r"""select doc_id as id, case when doc_id % 11 = 0 or doc_id % 13 = 0 then null when doc_id % 7 = 0 then '{}' when doc_id % 5 = 0 then '{{' when doc_id % 17 = 0 then null else doc_id || ':' || md5(text) end as text, case when doc_id % 11 = 0 or doc_id % 13 = 0 or doc_id % 7 = 0 then 0 when doc_id % 5 = 0 then 2 else 0 end::int as faults,
  case when doc_id % 11 = 0 then 'cut off' when doc_id % 13 = 0 then 'no answer' when doc_id % 7 = 0 or doc_id % 5 = 0 then null when doc_id % 17 = 0 then 'control characters' end as error, case when doc_id % 11 = 0 or doc_id % 13 = 0 then 1 when doc_id % 7 = 0 or doc_id % 5 = 0 or doc_id % 17 = 0 then 2 else 1 end::int as calls from documents""",
    "read_crops": "select distinct md5(name) as md5, case when not contains(name, 'eq003') then 'x_{' || name || '}' end as model_latex from image_box where name is not null",
    "tag_accuracy": f"""with {bank._LATEST}, a as (select subject, level, case when "questionNumber" % 4 = 0 then 'easy' when "questionNumber" % 4 = 1 then level when "questionNumber" % 4 = 2 then 'hard' end as said from lq where level is not null) select subject, count(*) as n, count(said) as given, count(*) filter (said = level) as correct, count(*) filter (said = level) / count(*) as share from a group by subject""",
    "symbols_read": f"select distinct doc_id || '/' || name as id, case ({_K.format('name')}) % 5 " + " ".join(f"when {k} then '{v}'" for k, v in _RING.items()) + " end as tex from image_box where name is not null",
    "figure_crops": f"select distinct doc_id || '/' || name as id, case ({_K.format('name')}) % 4 when 0 then 'coloured image (12.5% coloured pixels)' when 1 then 'long horizontal and vertical lines (graph, table or diagram)' end as reason from image_box where name is not null",
    "ink_regions": f"select distinct doc_id || '/' || name as id, case ({_K.format('name')}) % 3 when 0 then '33,95,107,135' when 1 then '33,95,157,135' else '33,95,157,135;183,195,277,245' end as regions from image_box where name is not null",
}
