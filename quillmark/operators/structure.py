"""Lines to exercises, questions and solutions with running counts only.

Every rule of the splitter is a running count, or a last value, over the ordered lines of a document: exercises open a
group, questions open a group within it, the first solution heading of a question opens its second section. The counts
run per block of lines and are carried from block to block, so a document of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as X

# Headings.
EXERCISE = r"(?i)^(EXERCISE\s+[\d.]+|MISCELLANEOUS EXERCISE|ADDITIONAL EXERCISES)\b|(?i)^(EXERCISE)\s*$"
QUESTION = r"(?i)^(?:Question|Ques\.?|Q\.)\s*([A-Z]?\d+(?:\.\d+)*)\s*[:.)]?"
SOLUTION = r"(?i)^(?:(Solution|Answer|Sol|Ans)\s*(?:[A-Z]?\d+(?:\.\d+)*)?\s*(?::|-|$)|(Sol|Ans)\.)"
CHAPTER = r"(?i)^Chapter\s+\d+.*"
LEAD = r"^(?:\[\[eq:[^\]]+\]\]\s*)+"
PAGE_NUMBER = r"(?i)^(?:page\s*)?[-–(]?\s*\d{1,4}\s*[-–)]?(?:\s*(?:of|/)\s*\d{1,4})?$"


def without_page_numbers(lines: DataFrame, height: float = 792.0) -> DataFrame:
    """Drop page-number lines in the top 5 % or bottom 8 % of the page. Null positions keep the line."""
    margin = (F.col("bottom") > 0.92 * height) | (F.col("top") < 0.05 * height)
    return lines.where(~F.coalesce(margin & F.col("text").rlike(PAGE_NUMBER), F.lit(False)))


#: Lines of a document that one window takes; longer documents are cut here and the counts carried over.
BLOCK = 20_000


def positions(d: DataFrame) -> DataFrame:
    """Lines with headings told (is_ch, is_ex, is_q, is_sol; heading, q_label) to where each stands: counts of chapters,
    exercises, questions and solutions so far, the open exercise's title and label of the open question, and the counts
    at which they opened.

    One pass per block of lines, in order; what a block starts from comes from the blocks before it, a row each, so no
    task holds a whole document."""
    own = W.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    kinds = ("ch", "ex", "q", "sol")
    d = d.withColumns({f"l_{k}": F.sum(F.col(f"is_{k}").cast("int")).over(own) for k in kinds})
    # what is open: (when it opens, its value there)
    opens = {"title": ("is_ex", F.col("heading_title")), "label": ("is_q", F.col("q_label")), "q_at_ex": ("is_ex", F.col("l_q")), "sol_at_q": ("is_q", F.col("l_sol")), "q_first": ("first_ex", F.col("l_q"))}
    d = d.withColumn("first_ex", F.col("is_ex") & (F.col("l_ex") == 1))
    at = {n: F.when(F.col(c), v) for n, (c, v) in opens.items()}
    local = d.withColumns({f"l_{n}": F.last(v, ignorenulls=True).over(own) for n, v in at.items()})
    totals = d.groupBy("doc_id", "block").agg(*(F.sum(F.col(f"is_{k}").cast("int")).alias(f"t_{k}") for k in kinds), *(F.max_by(v, F.when(F.col(opens[n][0]), F.col("line_no"))).alias(f"t_{n}") for n, v in at.items()))
    over = W.partitionBy("doc_id").orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumns({f"c_{k}": F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)) for k in kinds})
    # counts within a block become counts within the document
    whole = {"title": F.col("t_title"), "label": F.col("t_label"), "q_at_ex": F.col("t_q_at_ex") + F.col("c_q"), "sol_at_q": F.col("t_sol_at_q") + F.col("c_sol"), "q_first": F.when(F.col("c_ex") == 0, F.col("t_q_first") + F.col("c_q"))}
    carry = carry.select("doc_id", "block", *(f"c_{k}" for k in kinds), *(F.last(v, ignorenulls=True).over(before).alias(f"c_{n}") for n, v in whole.items()))
    j = local.join(carry, ["doc_id", "block"])
    now = {f"n_{k}": F.col(f"l_{k}") + F.col(f"c_{k}") for k in kinds}
    shift = {"q_at_ex": F.col("c_q"), "sol_at_q": F.col("c_sol")}
    now |= {n: F.coalesce(F.col(f"l_{n}") + shift[n] if n in shift else F.col(f"l_{n}"), F.col(f"c_{n}")) for n in ("title", "label", "q_at_ex", "sol_at_q")}
    now["q_first"] = F.coalesce("c_q_first", F.when(F.col("c_ex") == 0, F.col("l_q_first") + F.col("c_q")))
    gone = [c for c in j.columns if c[:2] in ("l_", "c_")]
    return j.withColumns(now).drop(*gone, "first_ex", "heading_title", "q_label")


def marked(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, page, text, x0, x1, top, bottom) with their exercise, question and section.

    Repeated (doc_id, line_no) keep one line; null texts are dropped. Text before the first question of an exercise
    belongs to nothing and is dropped; a second solution heading is content; the first chapter line is taken out."""
    one = lines.where("text is not null").dropDuplicates(["doc_id", "line_no"])
    lead = F.regexp_extract("text", LEAD, 0)
    d = one.withColumns({"lead": F.trim(lead), "core": F.substring("text", F.length(lead) + 1, F.length("text")), "block": F.floor(F.col("line_no") / BLOCK)})
    d = d.withColumns({"is_ch": F.col("core").rlike(CHAPTER), "is_ex": F.col("core").rlike(EXERCISE)})
    d = d.withColumn("is_q", ~F.col("is_ex") & F.col("core").rlike(QUESTION))
    d = d.withColumn("is_sol", ~F.col("is_ex") & ~F.col("is_q") & F.col("core").rlike(SOLUTION))
    title = F.upper(F.coalesce(F.nullif(F.regexp_extract("core", EXERCISE, 1), F.lit("")), F.regexp_extract("core", EXERCISE, 2)))
    d = positions(d.withColumns({"heading_title": F.when(F.col("is_ex"), title), "q_label": F.when(F.col("is_q"), F.regexp_extract("core", QUESTION, 1))}))
    d = d.where(~(F.col("is_ch") & (F.col("n_ch") == 1)))
    # questions before any exercise heading stand in an exercise of their own, which comes first
    orphans = F.when(F.col("n_ex") == 0, 1).otherwise((F.col("q_first") > 0).cast("int"))
    d = d.withColumns({"exercise": F.col("n_ex") - 1 + orphans, "question": F.col("n_q") - F.coalesce("q_at_ex", F.lit(0)) - 1, "title": F.coalesce("title", F.lit("UNKNOWN"))})
    d = d.where("question >= 0 and not is_ex")
    since = F.col("n_sol") - F.col("sol_at_q")
    d = d.withColumns({"opens": F.col("is_sol") & (since == 1), "section": F.when(since > 0, "solution").otherwise("question")})
    word = F.lower(F.coalesce(F.nullif(F.regexp_extract("core", SOLUTION, 1), F.lit("")), F.regexp_extract("core", SOLUTION, 2)))
    rest = lambda p: F.trim(F.concat_ws(" ", F.nullif("lead", F.lit("")), F.nullif(X.strip(F.regexp_replace("core", p, "")), F.lit(""))))
    content = F.when(F.col("is_q"), rest(QUESTION)).when(F.col("opens"), rest(SOLUTION)).otherwise(F.col("text"))
    return d.withColumns({"heading": F.when(F.col("opens"), F.when(word.startswith("ans"), "answer").otherwise("solution")), "content": content})


def sections(lines: DataFrame) -> DataFrame:
    """One row per question: (doc_id, exercise, title, question, label, number, page_start, heading, question_text,
    solution_text, lines)."""
    return sections_of(marked(lines))


def sections_of(m: DataFrame) -> DataFrame:
    """The same from marked lines."""
    joined = lambda s: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == s) & (F.col("content") != ""), F.struct("line_no", "content")))), lambda x: x["content"]), "\n"
    )
    return (
        m.groupBy("doc_id", "exercise", "question")
        .agg(
            F.max("title").alias("title"),
            F.max("label").alias("label"),
            F.min_by("page", "line_no").alias("page_start"),
            F.max("heading").alias("heading"),
            joined("question").alias("question_text"),
            joined("solution").alias("solution_text"),
            F.count("*").alias("lines"),
        )
        .withColumn("number", F.regexp_extract("label", r"(\d+)$", 1).try_cast("int"))
    )


def regions(lines: DataFrame) -> DataFrame:
    """One bounding box per question and page, rounded to a tenth; lines without a position do not count."""
    return regions_of(marked(lines))


def regions_of(m: DataFrame) -> DataFrame:
    """The same from marked lines."""
    m = m.where("x0 is not null and x1 is not null and top is not null and bottom is not null")
    g = m.groupBy("doc_id", "exercise", "question", "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    r1 = lambda c: F.floor(F.col(c) * 10.0 + 0.5).cast("double") / 10.0
    return g.select("doc_id", "exercise", "question", "page", *(r1(c).alias(c) for c in ("x0", "top", "x1", "bottom")))


def question_keys(sections_: DataFrame) -> DataFrame:
    """Position keys and readable ids; ids repeat where a title repeats."""
    return sections_.withColumn("key", F.concat_ws("-", "exercise", "question")).withColumn("name", F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit("_Q"), F.col("label")))


def slot_for(sections_: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, exercise, next_number): where a new question on a page belongs - the exercise with most questions
    on the page, the first of equals - and the next free number in it."""
    q = sections_.select("doc_id", "exercise", "question", "number", F.col("page_start").alias("page"))
    per = q.groupBy("doc_id", "page", "exercise").agg(F.count("*").alias("n"))
    best = per.groupBy("doc_id", "page").agg(F.max_by("exercise", F.struct("n", -F.col("exercise"))).alias("exercise"))
    top = q.groupBy("doc_id", "exercise").agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))
    last = q.groupBy("doc_id").agg(F.max("exercise").alias("last"))
    pages = lines.select("doc_id", "page").where("page is not null").distinct()
    at = pages.join(best, ["doc_id", "page"], "left").join(last, "doc_id").select("doc_id", "page", F.coalesce("exercise", "last").alias("exercise"))
    return at.join(top, ["doc_id", "exercise"]).select("doc_id", "page", "exercise", "next_number")


def markdown_parts(sections_: DataFrame) -> DataFrame:
    """(doc_id, exercise, question, part): every question as readable text, its exercise's heading before the first.
    A document of any size is written part by part (sinks.write_parts)."""
    body = lambda c: F.replace(F.regexp_replace(c, X.IMAGE_TOKEN, "![](images/$1)"), F.lit("\n"), F.lit("  \n"))
    q = F.concat(
        F.lit("\n### Question "), F.col("label"), F.lit("  (page "), F.col("page_start").cast("string"), F.lit(")\n\n**Question**\n\n"), body(F.col("question_text")), F.lit("\n\n**Solution**\n\n"), body(F.col("solution_text")), F.lit("\n")
    )
    first = F.col("question") == 0
    return sections_.select("doc_id", "exercise", "question", F.concat(F.when(first, F.concat(F.lit("\n## "), "title", F.lit("\n"))).otherwise(""), q).alias("part"))


def markdown(sections_: DataFrame) -> DataFrame:
    """(doc_id, markdown): every document as one readable text, in order: for documents that fit in a row."""
    return markdown_parts(sections_).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exercise", "question", "part"))), lambda x: x["part"]), "\n").alias("markdown"))
