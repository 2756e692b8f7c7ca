"""Titles to chapters of a syllabus: similarity join with refusal of ties, exact keys, fuzzy words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as X


def chapters(syllabus: DataFrame) -> DataFrame:
    """One row per chapter: key, its parts, topics in order, source."""
    g = syllabus.groupBy("className", "subject", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "topic"))).alias("t"), F.max("source").alias("source"))
    return g.select(F.concat_ws("/", "className", "subject", "chapter").alias("key"), "className", "subject", "chapter", F.transform("t", lambda x: x["topic"]).alias("topics"), "source")


def from_json_map(raw: DataFrame) -> DataFrame:
    """Rows of a syllabus file {"Class/Subject/Chapter": {"topics": [...], "source": ...}}: one per topic. Keys that do
    not have three parts are left out; a missing or broken file gives no rows."""
    m = F.from_json("value", "map<string, struct<topics: array<string>, source: string>>", {"mode": "PERMISSIVE"})
    e = raw.select(F.explode(m).alias("key", "v")).withColumn("p", F.split("key", "/"))
    return e.where(F.size("p") == 3).select(F.get("p", F.lit(0)).alias("className"), F.get("p", F.lit(1)).alias("subject"), F.get("p", F.lit(2)).alias("chapter"), F.posexplode("v.topics").alias("pos", "topic"), F.col("v.source").alias("source"))


def guess(titles: DataFrame, syllabus: DataFrame, least: float = 0.6, margin: float = 0.01) -> DataFrame:
    """(id, key, score): the chapter a title (id, title, subject, class_hint) most resembles.

    Score: Jaccard of the title words, less 0.15 where the subjects differ; a class hint must agree. Below ``least``,
    or with a runner-up within ``margin``, there is no answer. Candidates come from an equi-join on shared words - a
    title without a shared word scores 0 and could never win - so nothing is paired with everything; each distinct
    (title, subject, class) is scored once."""
    asked = titles.select("title", "subject", "class_hint").distinct().withColumn("w", F.array_distinct(X.title_words("title")))
    asked = asked.withColumn("qid", F.xxhash64("title", F.coalesce("subject", F.lit("\x00")), F.coalesce("class_hint", F.lit("\x00"))))
    c = chapters(syllabus).withColumn("cw", F.array_distinct(X.title_words("chapter")))
    hits = asked.select("qid", F.explode("w").alias("word")).join(c.select("key", F.explode("cw").alias("word")), "word").groupBy("qid", "key").agg(F.count("*").alias("shared"))
    j = hits.join(asked, "qid").join(c.select("key", "className", F.col("subject").alias("s"), F.size("cw").alias("nc")), "key")
    j = j.where(F.col("class_hint").isNull() | (F.lower("class_hint") == F.lower("className")))
    a, b = F.lower("subject"), F.lower("s")
    other = F.col("subject").isNotNull() & (F.col("subject") != "") & ~F.contains(a, b) & ~F.contains(b, a)
    score = F.col("shared") / F.greatest(F.size("w") + F.col("nc") - F.col("shared"), F.lit(1)) - F.when(other, 0.15).otherwise(0.0)
    by = W.partitionBy("qid").orderBy(F.desc("score"), "key")
    r = j.select("qid", "key", score.alias("score")).withColumn("next", F.lead("score").over(by)).withColumn("n", F.row_number().over(by)).where("n = 1")
    won = r.where((F.col("score") >= least) & (F.col("next").isNull() | (F.col("next") < F.col("score") - margin)))
    back = titles.withColumn("qid", F.xxhash64("title", F.coalesce("subject", F.lit("\x00")), F.coalesce("class_hint", F.lit("\x00"))))
    return back.join(won.select("qid", "key", "score"), "qid", "left").select("id", "key", "score")


def exact_key(rows: DataFrame, syllabus: DataFrame) -> DataFrame:
    """(id, key) by class, subject and chapter, ignoring case."""
    keys = chapters(syllabus).select("key", F.lower("key").alias("k"))
    return rows.withColumn("k", F.lower(F.concat_ws("/", "className", "subject", "chapter"))).join(keys, "k", "left").select("id", "key")


def fuzzy_match(titles: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, candidate, score): overlap where words also match by a common end with up to two letters more (titles that
    lost their decorated first letter). The first candidate (by ord) of equals; below ``least`` none.

    Words join by their last three letters, which any matching pair shares, or whole when shorter."""
    end = lambda w: F.when(F.length(w) > 3, F.right(w, F.lit(3))).otherwise(w)
    t = titles.withColumn("w", F.array_distinct(X.title_words("title")))
    c = candidates.withColumn("cw", F.array_distinct(X.title_words("candidate")))
    tw = t.select("id", F.explode("w").alias("a")).withColumn("e", end(F.col("a")))
    cw = c.select("candidate", F.explode("cw").alias("b")).withColumn("e", end(F.col("b")))
    same = (F.col("a") == F.col("b")) | ((F.length("a") > 3) & (F.length("b") > 3) & (F.endswith(F.col("a"), F.col("b")) | F.endswith(F.col("b"), F.col("a"))) & (F.abs(F.length("a") - F.length("b")) <= 2))
    hits = tw.join(cw, "e").where(same).groupBy("id", "candidate").agg(F.count_distinct("a").alias("hits"))
    s = hits.join(t, "id").join(c, "candidate").select("id", "candidate", "ord", (F.col("hits") / F.greatest(F.size(F.array_union("w", "cw")), F.lit(1))).alias("score"))
    return s.where(F.col("score") >= least).groupBy("id").agg(F.max_by("candidate", F.struct("score", -F.col("ord"))).alias("candidate"), F.max("score").alias("score"))


def chapter_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title) from the first page: lines of at least 85 % of the largest height, top to bottom."""
    h = (F.col("bottom") - F.col("top")).alias("h")
    p = lines.where("page = 1 and length(text) > 2 and not startswith(upper(text), 'CHAPTER')").where(~F.col("text").rlike(r"^\d+$")).select("doc_id", "line_no", "text", h)
    big = p.withColumn("big", F.max("h").over(W.partitionBy("doc_id"))).where("h >= 0.85 * big")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return big.groupBy("doc_id").agg(F.initcap(F.trim(F.regexp_replace(joined, r"\s+\d+$", ""))).alias("title"))


#: Numbered headings of sections and of subsections, headings that are no topics.
SECTION = r"^\s*(\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’'\-\(\)/&]{3,70})\s*$"
SUBSECTION = r"^\s*(\d+\.\d+\.\d+)\s+([A-Z][A-Za-z0-9 ,’'\-\(\)/&]{3,70})\s*$"
NO_TOPICS = ("introduction", "summary", "exercise", "exercises", "activity", "questions", "what you have learnt")


def chapter_topics(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, number, name): topics of a book's chapter from its lines (doc_id, line_no, text): section headings,
    or subsection headings where it has none; general headings and repeats are left out, the first stays."""
    take = lambda rx, level: lines.where(F.col("text").rlike(rx)).select("doc_id", "line_no", F.lit(level).alias("level"), F.regexp_extract("text", rx, 1).alias("number"), F.regexp_extract("text", rx, 2).alias("raw"))
    found = take(SECTION, 1).unionByName(take(SUBSECTION, 2))
    level = found.groupBy("doc_id").agg(F.min("level").alias("level"))
    named = found.join(level, ["doc_id", "level"], "left_semi").withColumn("name", F.regexp_replace(F.regexp_replace("raw", r"\s+", " "), r"^[ .]+|[ .]+$", "")).withColumn("k", F.lower("name"))
    first = named.where(~F.col("k").isin(*NO_TOPICS) & (F.length("name") >= 4)).groupBy("doc_id", "k").agg(F.min_by(F.struct("line_no", "number", "name"), "line_no").alias("r"))
    # headings of one document, not its lines
    return first.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("r.line_no")) - 1).alias("pos"), "r.number", "r.name")


def class_of(lines: DataFrame, height: float = 792.0) -> DataFrame:
    """(doc_id, class_name) read from the head of the first three pages (fixed value: 16 % of the height), the first that
    names one. What questions say of classes further down does not count."""
    head = lines.where((F.col("page") <= 3) & (F.col("bottom") <= 0.16 * height)).withColumn("c", X.class_name("text")).where("c is not null")
    return head.groupBy("doc_id").agg(F.min_by("c", F.struct("page", "line_no")).alias("class_name"))


def topics_allowed(rows: DataFrame, syllabus: DataFrame) -> DataFrame:
    """(id, topics): a row's own list, else its chosen chapter's, else the guessed chapter's, else none.
    rows: id, own array<string>, chosen string, guessed string."""
    c = chapters(syllabus).select("key", "topics")
    full = lambda a: F.when(F.size(a) > 0, a)
    j = rows.join(c.withColumnsRenamed({"key": "chosen", "topics": "t1"}), "chosen", "left").join(c.withColumnsRenamed({"key": "guessed", "topics": "t2"}), "guessed", "left")
    none = F.array().cast("array<string>")
    return j.select("id", F.when(F.size("own") > 0, F.col("own")).when(F.col("chosen").isNotNull(), F.coalesce("t1", none)).otherwise(F.coalesce(full(F.col("t2")), none)).alias("topics"))


def accepted_tags(answers: DataFrame, allowed: DataFrame, levels=("easy", "medium", "hard")) -> DataFrame:
    """Proposed tags (id, key, topic, level) kept only where the topic is in the allowed list as written and the level
    is known; ``placed`` where both are."""
    j = answers.join(allowed, "id", "left")
    topic = F.when(F.array_contains("topics", F.col("topic")), F.col("topic"))
    level = F.when(F.lower("level").isin(*levels), F.lower("level"))
    return j.select("id", "key", topic.alias("topic"), level.alias("level"), (topic.isNotNull() & level.isNotNull()).alias("placed"))
