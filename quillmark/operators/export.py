"""Merged questions to records of the fixed 34-field schema; stored names and urls; parents; upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import geometry as G
from quillmark.functions import text as X
from quillmark.operators.review import pick

CROP = "struct<url:string,type:string,optionIndex:int,nx:double,ny:double,nw:double,nh:double>"
RECORD = (
    "id string, documentId string, questionNumber int, path struct<module:string,chapter:string,section:string>, stem string, "
    "options array<struct<label:string,body:string,isCorrect:boolean>>, answer string, explanation string, images array<string>, match string, passageId string, "
    f"groupOrder int, isQuestionImage boolean, questionImage string, isOptionImage boolean, optionImages array<string>, answerImages array<string>, explanationImages array<string>, imageCrops array<{CROP}>, "
    "questionType string, level string, sectionName string, topic string, subject string, className string, exam string, flagged boolean, isPyq boolean, pyqExam string, pyqYear int, paper string, "
    "sourceRegion struct<page:int,bbox:array<double>>, createdAt string, updatedAt string"
)


def records(questions: DataFrame, manual: DataFrame, document: DataFrame, regions: DataFrame, boxes: DataFrame, now: str, base: str = "images/", page=(612.0, 792.0)) -> DataFrame:
    """Records of split questions (doc_id, exercise, question, title, label, number, heading, question_text,
    solution_text) under per-question and per-document settings.

    An edit ('' is one) replaces the automatic text, and pictures follow what the text still refers to. Text found
    under an answer heading is the answer, else the explanation; a choice question's answer is the label its solution
    names. Texts carry no pictures; all of them stand in the lists and crops. Skipped questions are left out."""
    none = F.array().cast("array<string>")
    q = questions.withColumn("key", F.concat_ws("-", "exercise", "question"))
    m = manual.select("doc_id", "key", *(F.col(c).alias(f"m_{c}") for c in manual.columns if c not in ("doc_id", "key")))
    d = document.select("doc_id", *(F.col(c).alias(f"d_{c}") for c in document.columns if c != "doc_id"))
    j = q.join(m, ["doc_id", "key"], "left").join(d, "doc_id", "left").where("not coalesce(m_skip, false)")
    ref = lambda c: F.regexp_replace(F.regexp_replace(c, X.IMAGE_TOKEN, f"![]({base}$1)"), X.IMAGE_REF, f"![]({base}$1)")
    names = lambda c: F.array_distinct(F.concat(F.coalesce(X.image_names(c), none), F.coalesce(F.regexp_extract_all(c, F.lit(X.IMAGE_REF), F.lit(1)), none)))
    raw_stem, raw_sol = F.coalesce("m_stemOverride", "question_text"), F.coalesce("m_solutionOverride", "solution_text")
    j = j.withColumn("stem0", X.strip(ref(raw_stem))).withColumn("sol0", F.nullif(X.strip(ref(raw_sol)), F.lit("")))
    j = j.withColumn("stem_names", names(raw_stem)).withColumn("sol_names", names(raw_sol))
    url = lambda a: F.transform(a, lambda n: F.concat(F.lit(base), n))
    j = j.withColumn("stem_imgs", url(F.col("stem_names"))).withColumn("sol_imgs", url(F.col("sol_names")))
    as_answer = (F.col("d_answerFrom") == "answer") | (F.coalesce(F.nullif("d_answerFrom", F.lit("")), F.lit("auto")).eqNullSafe("auto") & F.col("heading").eqNullSafe("answer"))
    j = j.withColumn("as_answer", F.coalesce(as_answer, F.lit(False)))
    j = j.withColumn("qtype", pick("m_questionType", "d_questionType", F.lit("subjective")))
    stem, options = X.split_options("stem0", "qtype")
    j = j.withColumn("stem1", stem).withColumn("options0", options)
    j = j.withColumn("options1", F.when(F.size("options0") > 0, X.mark_correct("options0", "sol0")).otherwise(F.col("options0")))
    picked = F.get(F.filter("options1", lambda o: o["isCorrect"]), F.lit(0))["label"]
    j = j.withColumn("picked", picked)
    j = j.withColumn("answer0", F.coalesce("picked", F.when(F.col("as_answer"), F.col("sol0"))))
    j = j.withColumn("explanation0", F.when(F.col("picked").isNotNull() | ~F.col("as_answer"), F.col("sol0")))
    j = j.withColumn("as_answer", F.col("as_answer") & F.col("picked").isNull())
    # crops: one row per picture used, joined to its box
    used = j.select("doc_id", "key", F.explode(F.array_distinct(F.concat(F.transform("stem_names", lambda n: F.struct(n.alias("name"), F.lit("question").alias("type"))), F.transform("sol_names", lambda n: F.struct(n.alias("name"), F.when(F.col("as_answer"), "answer").otherwise("solution").alias("type")))))).alias("u"))
    b = boxes.where(F.size("bbox") == 4).dropDuplicates(["doc_id", "name"]).select("doc_id", "name", G.normalised("bbox", F.lit(page[0]), F.lit(page[1])).alias("frac"))
    px = G.crop_pixels("frac", F.lit(page[0]), F.lit(page[1]))
    crop = F.struct(F.concat(F.lit(base), "u.name").alias("url"), F.col("u.type").alias("type"), F.lit(0).alias("optionIndex"), px["nx"].alias("nx"), px["ny"].alias("ny"), px["nw"].alias("nw"), px["nh"].alias("nh"))
    crops = used.join(b, (used.doc_id == b.doc_id) & (F.col("u.name") == b.name)).select(used.doc_id, "key", crop.alias("c")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("c")).alias("crops"))
    r = regions.groupBy("doc_id", "exercise", "question").agg(F.min_by(F.struct("page", F.array("x0", "top", "x1", "bottom").alias("bbox")), "page").alias("r"))
    region = r.select("doc_id", F.concat_ws("-", "exercise", "question").alias("key"), F.struct(F.col("r.page").alias("page"), G.normalised(F.col("r.bbox"), F.lit(page[0]), F.lit(page[1])).alias("bbox")).alias("region"))
    j = j.join(crops, ["doc_id", "key"], "left").join(region, ["doc_id", "key"], "left")
    exam_found, year_found = X.pyq_exam("question_text"), X.pyq_year("question_text")
    is_pyq = F.coalesce("m_isPyq", "d_isPyq", exam_found.isNotNull())
    section = F.when(F.col("title") != "UNKNOWN", F.col("title"))
    return j.select(
        X.stable_id("doc_id", "key").alias("id"),
        F.col("d_documentId").alias("documentId"),
        F.coalesce(X.to_int("m_questionNumber"), "number").alias("questionNumber"),
        F.struct(F.nullif("d_module", F.lit("")).alias("module"), F.nullif("d_chapter", F.lit("")).alias("chapter"), F.coalesce(F.nullif("d_section", F.lit("")), F.lit("All sections")).alias("section")).alias("path"),
        X.strip_images("stem1").alias("stem"),
        F.col("options1").alias("options"),
        F.coalesce(X.strip_images("answer0"), F.lit("")).alias("answer"),
        X.strip_images("explanation0").alias("explanation"),
        F.array_distinct(F.concat("stem_imgs", "sol_imgs")).alias("images"),
        F.lit(None).cast("string").alias("match"),
        F.lit(None).cast("string").alias("passageId"),
        F.lit(None).cast("int").alias("groupOrder"),
        (F.size("stem_imgs") > 0).alias("isQuestionImage"),
        F.get("stem_imgs", F.lit(0)).alias("questionImage"),
        F.lit(False).alias("isOptionImage"),
        none.alias("optionImages"),
        F.when(F.col("as_answer"), F.col("sol_imgs")).otherwise(none).alias("answerImages"),
        F.when(F.col("as_answer"), none).otherwise(F.col("sol_imgs")).alias("explanationImages"),
        F.coalesce("crops", F.array().cast(f"array<{CROP}>")).alias("imageCrops"),
        F.col("qtype").alias("questionType"),
        pick("m_level", "d_level").alias("level"),
        pick("m_sectionName", "d_sectionName", section).alias("sectionName"),
        pick("m_topic", "d_topic").alias("topic"),
        F.nullif("d_subject", F.lit("")).alias("subject"),
        F.nullif("d_className", F.lit("")).alias("className"),
        X.normalize_exam("d_exam").alias("exam"),
        F.coalesce("m_flagged", F.col("sol0").isNull()).alias("flagged"),
        is_pyq.alias("isPyq"),
        F.when(is_pyq, pick("m_pyqExam", "d_pyqExam", exam_found)).alias("pyqExam"),
        F.when(is_pyq, F.coalesce(X.to_int("m_pyqYear"), X.to_int("d_pyqYear"), year_found)).alias("pyqYear"),
        F.when(is_pyq, pick("m_paper", "d_paper")).alias("paper"),
        F.col("region").alias("sourceRegion"),
        F.lit(now).alias("createdAt"),
        F.lit(now).alias("updatedAt"),
    )


#: Columns records() reads from the two override tables.
MANUAL = "doc_id int, key string, topic string, level string, questionType string, sectionName string, isPyq boolean, pyqExam string, pyqYear string, paper string, flagged boolean, skip boolean, stemOverride string, solutionOverride string, questionNumber string"
DOCUMENT = "doc_id int, documentId string, module string, chapter string, subject string, className string, exam string, section string, sectionName string, questionType string, level string, topic string, isPyq boolean, pyqExam string, pyqYear string, paper string, answerFrom string"


def to_documents(recs: DataFrame) -> DataFrame:
    """Records as stored: picture lists of older records filled from their crops, the old crop type renamed, dates as
    timestamps, a default section, normal exam names. The input stays as it is."""
    of = lambda *kinds: F.array_distinct(F.transform(F.filter("imageCrops", lambda c: c["type"].isin(*kinds) & F.coalesce(c["url"] != "", F.lit(False))), lambda c: c["url"]))
    renamed = F.transform("imageCrops", lambda c: F.when(c["type"] == "explanation", c.withField("type", F.lit("solution"))).otherwise(c))
    return (
        recs.withColumn("answerImages", F.coalesce("answerImages", of("answer")))
        .withColumn("explanationImages", F.coalesce("explanationImages", of("solution", "explanation")))
        .withColumn("imageCrops", renamed)
        .withColumn("exam", X.normalize_exam("exam"))
        .withColumn("createdAt", X.from_iso("createdAt"))
        .withColumn("updatedAt", X.from_iso("updatedAt"))
        .withColumn("path", F.when(F.col("path").isNotNull(), F.col("path").withField("section", F.coalesce(F.nullif(F.col("path.section"), F.lit("")), F.lit("All sections")))))
    )


def object_names(recs: DataFrame) -> DataFrame:
    """(id, url, file, object): stored name of each picture, <id>_<kind>_<index>_<stamp>. The stamp comes from the id,
    so a second push finds the first one's object; of two crops with one url the last index counts; only option crops
    are filed as options."""
    c = recs.select("id", F.posexplode("imageCrops").alias("i", "c")).where("coalesce(c.url, '') <> ''")
    last = c.groupBy("id", F.col("c.url").alias("url")).agg(F.max_by(F.struct("i", F.col("c.type").alias("type")), "i").alias("x"))
    kind = F.when(F.col("x.type") == "option", "option").otherwise("question")
    return last.select("id", "url", F.regexp_replace("url", "^.*/", "").alias("file"), F.concat_ws("_", "id", kind, F.col("x.i").cast("string"), X.id_stamp("id").cast("string")).alias("object"))


def rewritten_urls(recs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with every picture reference - lists, single, crops, texts - pointed at its stored place.
    mapping: (id, url, new_url)."""
    m = mapping.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("url", "new_url"))).alias("__m"))
    j = recs.join(m, "id", "left").withColumn("__m", F.coalesce("__m", F.create_map().cast("map<string,string>")))
    new = lambda u: F.coalesce(F.try_element_at(F.col("__m"), u), u)
    out = j
    for f in ("images", "optionImages", "answerImages", "explanationImages"):
        out = out.withColumn(f, F.transform(f, new))
    out = out.withColumn("questionImage", F.when(F.col("questionImage").isNotNull(), new(F.col("questionImage"))))
    out = out.withColumn("imageCrops", F.transform("imageCrops", lambda c: c.withField("url", F.when(c["url"].isNotNull(), new(c["url"])))))
    for f in ("stem", "answer", "explanation"):
        swap = F.aggregate(F.map_entries("__m"), F.col(f), lambda t, e: F.replace(t, F.concat(F.lit("![]("), e["key"], F.lit(")")), F.concat(F.lit("![]("), e["value"], F.lit(")"))))
        out = out.withColumn(f, swap)
    return out.drop("__m")


def upserted(base: DataFrame, updates: DataFrame, key: str, order: list[str], on_insert: tuple[str, ...] = ()) -> DataFrame:
    """A new version of a table: rows of the base replaced by the last update of their key, new keys added.
    ``on_insert`` columns keep the base's value where there is one. ``action`` says what became of each row."""
    from quillmark.operators.review import latest

    cols = [c for c in base.columns if c != key]
    u = latest(updates.select(key, *cols), [key], order).select(F.col(key).alias("__k"), *(F.col(c).alias(f"u_{c}") for c in cols), F.lit(True).alias("u_hit"))
    j = base.withColumn("__b", F.lit(True)).join(u, base[key] == F.col("__k"), "full_outer")
    hit, was = F.coalesce("u_hit", F.lit(False)), F.coalesce("__b", F.lit(False))
    val = lambda c: F.when(was, F.col(c)).otherwise(F.col(f"u_{c}")) if c in on_insert else F.when(hit, F.col(f"u_{c}")).otherwise(F.col(c))
    return j.select(F.coalesce(F.col(key), F.col("__k")).alias(key), *(val(c).alias(c) for c in cols), F.when(hit & was, "updated").when(hit, "new").otherwise("kept").alias("action"))
