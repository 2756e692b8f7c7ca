"""Writers: records, readable text, bundles with their pictures, objects of a store, zips, versioned tables."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.runtime import file_system, written


def write_records(records: DataFrame, path: str, by: str | None = "documentId") -> None:
    """JSON lines, one folder per document; Spark's commit makes the write all or nothing."""
    w = records.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(by) if by else w).json(path)


def write_text(rows: DataFrame, path: str, column: str = "markdown") -> None:
    """One readable text per row, in files of Spark's choosing; the key stays in a folder name."""
    key = next(c for c in rows.columns if c != column)
    rows.select(key, F.col(column).alias("value")).write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def write_parts(parts: DataFrame, path: str, key: str, order: list[str], column: str = "part") -> None:
    """One readable text per key, written part by part in order: nothing is ever gathered into one value."""
    rows = parts.repartition(key).sortWithinPartitions(key, *order).select(key, F.col(column).alias("value"))
    rows.write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def bundle_plan(records: DataFrame, source: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state) of the pictures of a bundle: wanted by its records and at hand in the source (copy), wanted and
    nowhere (missing), present and no longer wanted (stale)."""
    wanted = records.select(F.explode("imageCrops").alias("c")).select(F.regexp_replace("c.url", "^.*/", "").alias("name")).where("name <> ''").distinct()
    j = wanted.join(source.select("name").distinct().withColumn("here", F.lit(True)), "name", "left")
    state = j.select("name", F.when(F.col("here"), "copy").otherwise("missing").alias("state"))
    return state.unionByName(present.select("name").distinct().join(wanted, "name", "left_anti").select("name", F.lit("stale").alias("state")))


def _files(spark, folder: str) -> DataFrame:
    """(name) of the files of a folder; empty where there is none."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], "name string")
    return spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^.*/", "").alias("name"))


def bundle(records: DataFrame, source: str, target: str) -> dict[str, int | DataFrame]:
    """Records and the pictures they use in one folder of any store: counts of questions and images, and the missing
    names as a table. Pictures no longer wanted are deleted. Executors copy and delete, a partition at a time; a picture
    copied again is the same picture, so a lost executor costs only its own share."""
    spark = records.sparkSession
    images = f"{target}/images"
    plan = written(bundle_plan(records, _files(spark, source), _files(spark, images)), "bundle")

    def move(batches):
        import pandas as pd
        from pyarrow import fs

        (src, at), (dst, to) = (fs.FileSystem.from_uri(u if "://" in u else f"file://{u}") for u in (source, images))
        for b in batches:
            for name, state in zip(b["name"], b["state"]):
                if state == "copy":
                    dst.create_dir(to, recursive=True)
                    part = f"{to}/.{name}.{uuid.uuid4().hex}"
                    with src.open_input_stream(f"{at}/{name}") as r, dst.open_output_stream(part) as w:
                        while chunk := r.read(1 << 20):
                            w.write(chunk)
                    dst.move(part, f"{to}/{name}")
                else:
                    try:
                        dst.delete_file(f"{to}/{name}")
                    except FileNotFoundError:  # an earlier attempt of the task took it away
                        pass
            yield pd.DataFrame({"state": b["state"]})

    done = {r.state: r["count"] for r in plan.where("state <> 'missing'").mapInPandas(move, "state string").groupBy("state").count().collect()}
    write_records(records, f"{target}/questions", by=None)
    return {"questions": spark.read.json(f"{target}/questions", schema=records.schema).count(), "images": done.get("copy", 0), "missing": plan.where("state = 'missing'").select("name")}


def put_objects(names: DataFrame, read: Callable[[str], bytes | None], exists: Callable[[str], bool], put: Callable[[str, bytes], None], write: bool = False) -> DataFrame:
    """(file, object, outcome) of putting files under their object names: stored, reused or missing. A dry run by
    default; putting again reuses. The three callables talk to the store, one client per call site and partition."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for f, o in zip(pdf.file, pdf.object):
                if exists(o):
                    out.append((f, o, "reused"))
                    continue
                data = read(f)
                if data is None:
                    out.append((f, o, "missing"))
                    continue
                if write:
                    put(o, data)
                out.append((f, o, "stored"))
            yield pd.DataFrame(out, columns=["file", "object", "outcome"])

    return names.select("file", "object").distinct().mapInPandas(run, "file string, object string, outcome string")


def zip_files(names: list[str], source: str, target: str) -> int:
    """Distinct base names that exist, in one zip; a download for one job, so it is made where it is asked for."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted({os.path.basename(x) for x in names}):
            if os.path.isfile(p := os.path.join(source, name)):
                z.write(p, name)
                n += 1
    return n


def zip_names(used: DataFrame, present: DataFrame) -> DataFrame:
    """(name) of the pictures (url) an archive will hold: distinct base names that are at hand."""
    return used.select(F.regexp_replace("url", "^.*/", "").alias("name")).where("name <> ''").distinct().join(present.select("name").distinct(), "name", "left_semi")


def class_counts(files: DataFrame) -> DataFrame:
    """Files per class and subject: what each group's archive will hold."""
    return files.groupBy("className", "subject").agg(F.count("*").alias("files"))


def write_version(table: DataFrame, root: str, version: int, by: str | None = None) -> str:
    """A new version of a table beside the old ones, and a pointer to it that is replaced in one step."""
    path = f"{root}/v{version:08d}"
    w = table.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)
    table.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


def read_version(spark, root: str) -> DataFrame:
    """The version of a table its pointer names."""
    v = spark.read.schema("version int").json(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/v{v:08d}")


def drive_path(exam, subject, module, chapter):
    """Folder of a file from its non-blank parts (Column)."""
    return F.concat_ws("/", *(F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in (exam, subject, module, chapter)))


def ensure(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The table with the wanted rows it lacks; rows it has stay as they are."""
    return table.unionByName(wanted.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))
