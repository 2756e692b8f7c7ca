"""Readers: JSON documents, OCR page caches, PDF files, settings; nothing is inferred from the data."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.runtime import file_system

READING = "struct<latex:string,raw:string,source:string,kind:string,confidence:double,needs_review:boolean,reason:string,katex_error:string,ai_error:string,model:string>"
SECTION = f"struct<text:string,text_latex:string,equations:array<string>,equations_latex:map<string,{READING}>>"
BOX = "struct<page:int,bbox:array<double>>"
STRUCTURED = (
    "chapter string, structure_version int, figures_checked boolean, page_sizes map<string,array<double>>, scanned_pages array<int>, ai_ocr_pages array<int>, deleted_images array<string>, "
    f"image_boxes map<string,{BOX}>, exercises array<struct<title:string,questions:array<struct<number:int,label:string,page_start:int,solution_heading:string,regions:array<{BOX}>,question:{SECTION},solution:{SECTION}>>>>"
)
REVIEW = (
    "document struct<documentId:string,sessionId:string,driveFileId:string,projectId:string,module:string,chapter:string,subject:string,className:string,exam:string,section:string,sectionName:string,questionType:string,level:string,topic:string,isPyq:boolean,pyqExam:string,pyqYear:string,paper:string,answerFrom:string,imageBaseUrl:string,syllabusChapter:string,topics:array<string>>, "
    "questions map<string,struct<topic:string,level:string,questionType:string,sectionName:string,isPyq:boolean,pyqExam:string,pyqYear:string,paper:string,flagged:boolean,skip:boolean,stemOverride:string,solutionOverride:string,aiReread:boolean,questionNumber:string>>, "
    f"ids map<string,string>, manualImages map<string,{BOX}>, addedQuestions array<struct<id:string,label:string,stem:string,solution:string,exercise:string,page:int,number:int,bbox:array<double>>>"
)


def read_json(spark: SparkSession, path: str, schema: str, required: bool = False, name: str = "*.json") -> DataFrame:
    """JSON files below a folder, one document each, with their path. A missing folder gives no rows; a broken file is
    an error where the documents are required, else left out."""
    full = spark.createDataFrame([], schema).schema
    if not _exists(spark, path):
        return spark.createDataFrame([], full.add("path", T.StringType()))
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if required:
        return r.option("mode", "FAILFAST").schema(full).json(path).withColumn("path", F.input_file_name())
    kept = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(T.StructType([*full.fields, T.StructField("_corrupt", T.StringType())])).json(path)
    return kept.withColumn("path", F.input_file_name()).where("_corrupt is null").drop("_corrupt")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def job_name(path) -> Column:
    """The folder a document lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_roots(spark: SparkSession, roots: list[str], schema: str, **kw) -> DataFrame:
    """Documents of several roots; of folders with one name the first root's is read."""
    from quillmark.operators.sets import first_root_wins

    return first_root_wins([read_json(spark, r, schema, **kw).withColumn("job", job_name("path")) for r in roots], "job")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review states with defaults in place of what older files lack; exam names in normal form."""
    return with_defaults(read_json(spark, path, REVIEW, required=True, name="review.json"))


def with_defaults(r: DataFrame) -> DataFrame:
    """Review states with empty maps and lists in place of null ones, and the exam's name in normal form."""
    from quillmark.functions import text as X

    empty = lambda c, t: F.coalesce(F.col(c), F.create_map().cast(t) if t.startswith("map") else F.array().cast(t))
    kinds = {f.name: f.dataType.simpleString() for f in r.schema.fields}
    for c in ("questions", "ids", "manualImages", "addedQuestions"):
        r = r.withColumn(c, empty(c, kinds[c]))
    return r.withColumn("document", F.when(F.col("document").isNotNull(), F.col("document").withField("exam", X.normalize_exam("document.exam"))))


def flat_sections(docs: DataFrame) -> DataFrame:
    """Structured documents as one row per section: (job, key, part, text, equations, readings)."""
    d = docs.withColumn("job", job_name("path"))
    e = d.select("job", F.posexplode("exercises").alias("ei", "ex")).select("job", "ei", "ex.title", F.posexplode("ex.questions").alias("qi", "q"))
    parts = F.explode(F.array(F.struct(F.lit("question").alias("part"), F.col("q.question").alias("s")), F.struct(F.lit("solution").alias("part"), F.col("q.solution").alias("s"))))
    return e.select("job", F.concat_ws("-", "ei", "qi").alias("key"), "title", "q.label", parts.alias("p")).select("job", "key", "title", "label", "p.part", "p.s.text", "p.s.equations", F.col("p.s.equations_latex").alias("readings"))


OCR_PAGE = "text array<array<string>>, regions array<array<string>>"


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached OCR pages (ocr_pNNN.json) as tokens: (job, page, kind, value, top, bottom, x0, x1)."""
    p = read_json(spark, path, OCR_PAGE, name="ocr_p*.json").withColumn("job", job_name("path")).withColumn("page", F.regexp_extract("path", r"ocr_p(\d+)\.json$", 1).cast("int"))
    num = lambda a, i: F.get(a, F.lit(i)).try_cast("double")
    t = p.select("job", "page", F.explode("text").alias("a")).select("job", "page", F.lit("text").alias("kind"), F.get("a", F.lit(4)).alias("value"), num("a", 0).alias("top"), num("a", 1).alias("bottom"), num("a", 2).alias("x0"), num("a", 3).alias("x1"))
    r = p.select("job", "page", F.explode("regions").alias("a")).select("job", "page", F.lit("eq").alias("kind"), F.get("a", F.lit(0)).alias("value"), num("a", 2).alias("top"), num("a", 4).alias("bottom"), num("a", 1).alias("x0"), num("a", 3).alias("x1"))
    return t.unionByName(r)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, sha256, is_pdf) of files below a folder; a file without the PDF magic is none."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.regexp_replace("path", "^.*/", "").alias("name"), "length", F.sha2("content", 256).alias("sha256"), is_pdf("content").alias("is_pdf"))


def is_pdf(content) -> Column:
    """Whether a file's bytes begin with the PDF magic; empty and null files are none."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.substring(c, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def pdf_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Words of PDF pages as tokens; needs pdfplumber on the executors."""

    def run(batches):
        import io

        import pandas as pd
        import pdfplumber

        for pdf in batches:
            out = []
            for p, content in zip(pdf.path, pdf.content):
                with pdfplumber.open(io.BytesIO(content)) as doc:
                    for n, page in enumerate(doc.pages, 1):
                        out += [(p, n, "text", w["text"], w["top"], w["bottom"], w["x0"], w["x1"]) for w in page.extract_words()]
                        out += [(p, n, "eq", f"p{n:03d}_eq{i:03d}.png", im["top"], im["bottom"], im["x0"], im["x1"]) for i, im in enumerate(page.images) if im["x1"] - im["x0"] >= 4 and im["bottom"] - im["top"] >= 4]
            yield pd.DataFrame(out, columns=["path", "page", "kind", "value", "top", "bottom", "x0", "x1"])

    try:
        import pdfplumber  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF pages needs pdfplumber; start from tokens or lines instead") from e
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, kind string, value string, top double, bottom double, x0 double, x1 double")


def book_parts(paths: DataFrame) -> DataFrame:
    """(className, subject, chapter) from folders Class N/Subject/Chapter NN - Name.pdf; null class where there is none."""
    from quillmark.functions import text as X

    s = F.split("path", "/")
    up = lambda i: F.try_element_at(s, F.lit(i))
    return paths.select("path", F.when(up(-3).rlike(r"(?i)^class\s*\d+$"), up(-3)).alias("className"), up(-2).alias("subject"), X.chapter_of_file("path").alias("chapter"))


#: A line of a settings file.
SETTING = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"


def settings_rows(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """(keep..., name, value): settings among lines of text, quotes around a value taken off; other lines are none."""
    v = F.regexp_extract(line, SETTING, 2)
    bare = F.when(v.rlike("^(?:\".*\"|'.*')$") & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return lines.where(F.col(line).rlike(SETTING)).select(*keep, F.regexp_extract(line, SETTING, 1).alias("name"), bare.alias("value"))


def settings(path: str, override: bool = False) -> dict[str, str]:
    """KEY=value lines of a settings file put into the environment; what is set there already wins unless overridden."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                m = re.match(SETTING, line)
                if m:
                    k, v = m.groups()
                    out[k] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    for k, v in out.items():
        if override or k not in os.environ:
            os.environ[k] = v
    return out
