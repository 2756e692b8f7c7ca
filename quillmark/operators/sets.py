"""Membership, differences, duplicates of files, links between tables, cache lookups."""

from __future__ import annotations

import copy
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X


def first_root_wins(roots: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which an earlier table's row hides later ones of the same key."""
    out = None
    for n, df in enumerate(roots):
        one = df.withColumn("__root", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ("__root", key)]
    g = out.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("__root", F.to_json(F.struct(*cols)))).alias("r"))
    return g.select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def missing_and_stale(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): wanted but not there, and there but no longer wanted."""
    w, p = wanted.select(key).where(F.col(key).isNotNull()).distinct(), present.select(key).where(F.col(key).isNotNull()).distinct()
    return w.join(p, key, "left_anti").select(key, F.lit("missing").alias("state")).unionByName(p.join(w, key, "left_anti").select(key, F.lit("stale").alias("state")))


def active_links(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """(documentId, sessionId) of documents linked to a session that exists and is not deleted; ill-formed ids out."""
    d = documents.where(F.col("sessionId").isNotNull() & F.col("documentId").rlike("^[0-9a-fA-F]{24}$")).select("documentId", "sessionId").distinct()
    return d.join(sessions.where("deletedAt is null").select("sessionId").distinct(), "sessionId", "left_semi").select("documentId", "sessionId")


def duplicates_of_files(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (upload_id, fileName, sha) with the earlier file they repeat: by content, else by name among files whose
    content is not known. known: (file_id, fileName, sha, pos); the first by pos."""
    first = lambda d, k: d.groupBy(k).agg(F.min_by("file_id", F.struct("pos", "file_id")).alias("hit"))
    by_sha = first(known.where("sha is not null"), "sha").withColumnRenamed("hit", "by_content")
    by_name = first(known.where("sha is null").withColumn("name", F.lower("fileName")), "name").withColumnRenamed("hit", "by_name")
    j = uploads.withColumn("name", F.lower("fileName")).join(by_sha, "sha", "left").join(by_name, "name", "left")
    return j.select("upload_id", F.coalesce("by_content", "by_name").alias("file_id"), F.when(F.col("by_content").isNotNull(), "content").when(F.col("by_name").isNotNull(), "filename").alias("match"))


def same_file_twice(files: DataFrame) -> DataFrame:
    """Files whose content arrived before under another id: (documentId, first_id)."""
    f = files.where("pdfSha256 is not null").groupBy("documentId", "pdfSha256").agg(F.min("createdAt").alias("createdAt"))
    first = f.groupBy("pdfSha256").agg(F.min_by("documentId", F.struct("createdAt", "documentId")).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return f.join(first, "pdfSha256").where("documentId <> first_id").select("documentId", "first_id")


def requested(asked: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """What was asked for and is not there yet."""
    return asked.select(key).distinct().join(existing.select(key).distinct(), key, "left_anti")


def shared_words(pairs: DataFrame) -> DataFrame:
    """(id, common): words two texts share, with repeats (the smaller of both counts); pairs without any are left out."""
    return pairs.select("id", X.shared_count(X.prose_words("a"), X.prose_words("b")).alias("common")).where("common > 0")


def ordered_union(*arrays):
    """Arrays concatenated, each element once at its first place (Column)."""
    return F.array_distinct(F.concat(*(F.coalesce(X._c(a), F.array().cast("array<string>")) for a in arrays)))


def pages_seen(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, pages): declared scanned pages and pages named by OCR crops, once each, ascending."""
    seen = names.where("name like '%\\_ocr%'").select("doc_id", F.regexp_extract("name", r"^p(\d+)_", 1).try_cast("int").alias("page")).groupBy("doc_id").agg(F.collect_set("page").alias("seen"))
    none = F.array().cast("array<int>")
    return documents.join(seen, "doc_id", "left").select("doc_id", F.array_sort(F.array_union(F.coalesce("scanned_pages", none), F.coalesce("seen", none))).alias("pages"))


def cache_lookup(work: DataFrame, cache: DataFrame, version: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of work (id, md5) in a cache (key, kind, latex, error). An answer counts only without an error and
    with a usable value; failed ones are asked again. Each distinct digest is asked once."""
    w = work.withColumn("key", F.concat(F.lit(f"v{version}:{model}:"), "md5"))
    good = cache.where("error is null and (coalesce(latex, '') <> '' or kind in ('figure', 'blank'))").dropDuplicates(["key"]).select("key", "kind", "latex")
    hits = w.join(good, "key").select("id", "md5", "kind", "latex")
    return hits, w.join(good, "key", "left_anti").select("md5").distinct()


def job_list(jobs: DataFrame, live: DataFrame, meta: DataFrame, links: DataFrame) -> DataFrame:
    """Jobs with their status (live before stored), file name, number of questions and session (own before linked),
    newest first."""
    j = (
        jobs.join(live.select("job_id", F.col("status").alias("live_status")), "job_id", "left")
        .join(meta.select("job_id", "filename", "questions", "documentId", F.col("sessionId").alias("own")), "job_id", "left")
        .join(links.select("documentId", F.col("sessionId").alias("linked")), "documentId", "left")
    )
    return j.select("job_id", F.coalesce("live_status", "status").alias("status"), "filename", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("own", "linked").alias("sessionId"), "uploadedAt").orderBy(F.desc("uploadedAt"), "job_id")


def drive_id(session, meta, document, ingest):
    """The first real file id by precedence; ``local:`` ids are none (Column)."""
    real = lambda c: F.when(~F.coalesce(X._c(c), F.lit("")).startswith("local:") & (F.coalesce(X._c(c), F.lit("")) != ""), X._c(c))
    return F.coalesce(*(real(c) for c in (session, meta, document, ingest)))


def resumable(jobs: DataFrame) -> DataFrame:
    """Interrupted uploads to run again: still extracting, with a source to read, in order of arrival."""
    return jobs.where("status = 'extracting' and driveFileId is not null and not startswith(driveFileId, 'local:')").orderBy("uploadedAt", "job_id")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def project_deleted(projects: DataFrame, sessions: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    """Projects without one of them, and sessions released from it."""
    return projects.where(F.col("projectId") != gone), sessions.withColumn("projectId", F.when(F.col("projectId") != gone, F.col("projectId")))


def updated(rows: DataFrame, changes: DataFrame, key: str, label: str, now) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): fields set where a change (key and fields, null for no change) meets its row, and ``updatedAt`` with
    them. Refused are changes to what is not there (missing) and to a blank label; of several changes of a key the last
    by its fields counts."""
    fields = [c for c in changes.columns if c != key]
    c = changes.groupBy(key).agg(F.max(F.struct(*fields)).alias("c"))
    blank = F.coalesce(X.strip(F.col(f"c.{label}")) == "", F.lit(False))
    here = c.join(rows.select(key).distinct(), key, "left_semi")
    refused = c.join(rows.select(key).distinct(), key, "left_anti").select(key, F.lit("missing").alias("reason")).unionByName(here.where(blank).select(key, F.lit("blank label").alias("reason")))
    j = rows.join(here.where(~blank), key, "left")
    new = {f: F.coalesce(X.strip(F.col(f"c.{f}")) if f == label else F.col(f"c.{f}"), F.col(f)) for f in fields}
    new["updatedAt"] = F.when(F.col("c").isNotNull(), X._c(now)).otherwise(F.col("updatedAt"))
    return j.select(*(new.get(n, F.col(n)).alias(n) for n in rows.columns)), refused


def project_rows(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects (projectId, label, updatedAt) and sessions (sessionId, label, projectId, status, driveFileId, updatedAt) as
    one list, projects first, newest first in each: (kind, id, label, projectId, status, driveFileId). A session without
    a label or status has the usual one. Only these columns are read."""
    none = F.lit(None).cast("string")
    p = projects.select(F.lit("project").alias("kind"), F.col("projectId").alias("id"), "label", none.alias("projectId"), none.alias("status"), none.alias("driveFileId"), "updatedAt")
    s = sessions.select(F.lit("session").alias("kind"), F.col("sessionId").alias("id"), F.coalesce("label", F.lit("Untitled OCR session")).alias("label"), "projectId", F.coalesce("status", F.lit("open")).alias("status"), "driveFileId", "updatedAt")
    return p.unionByName(s).orderBy("kind", F.desc("updatedAt"), "id").drop("updatedAt")


class TimedTables:
    """Small tables read once and kept for a while: a read within ``seconds`` of the last gives the kept rows, a write
    forgets them. Rows are copies, so that what a reader does to them changes nothing."""

    def __init__(self, read, seconds: float = 5.0, clock=time.monotonic) -> None:
        self.read, self.seconds, self.clock, self.kept = read, seconds, clock, {}

    def get(self, name: str) -> list[dict]:
        at, rows = self.kept.get(name, (None, None))
        if at is None or self.clock() - at >= self.seconds:
            rows = [r.asDict(recursive=True) for r in self.read(name).collect()]
            self.kept[name] = (self.clock(), rows)
        return copy.deepcopy(rows)

    def forget(self, name: str | None = None) -> None:
        self.kept.pop(name, None) if name else self.kept.clear()


def top_n(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in a total order: a report, not a way to save work."""
    return rows.orderBy(*order).limit(n)


def links_in(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, pos, url, slug, id): links of a page in order, each target id once at its first place."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "url"))
    parts = found.withColumn("s", F.split("url", "/")).withColumn("id", F.element_at("s", -1)).withColumn("slug", F.try_element_at("s", F.lit(-2)))
    g = parts.groupBy("page_id", "id").agg(F.min_by(F.struct("pos", "url", "slug"), "pos").alias("r"))
    return g.select("page_id", "r.pos", "r.url", "r.slug", "id")
