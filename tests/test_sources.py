import json
import os

import pytest
from pyspark.sql import functions as F

from quillmark.sources import documents as D
from quillmark.sources import sinks
from quillmark.streaming import jobs as J


def put(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


DOC = {
    "chapter": None, "structure_version": 8,
    "exercises": [{"title": "UNKNOWN", "questions": [{"number": 1, "question": {"text": "What is 1 + 1?", "equations": ["a.png"], "equations_latex": {"a.png": {"latex": "x", "needs_review": False}}}, "solution": {"text": "2"}}]}],
}


def test_json_documents(spark, tmp_path):
    put(f"{tmp_path}/j1/structured.json", DOC)
    put(f"{tmp_path}/j2/structured.json", "{broken")
    d = D.read_json(spark, str(tmp_path), D.STRUCTURED, name="structured.json")
    s = D.flat_sections(d).orderBy("part").collect()
    assert [(r.job, r.key, r.part, r.text) for r in s] == [("j1", "0-0", "question", "What is 1 + 1?"), ("j1", "0-0", "solution", "2")]
    assert s[0].readings["a.png"].latex == "x"
    assert D.read_json(spark, f"{tmp_path}/none", D.STRUCTURED).count() == 0
    with pytest.raises(Exception):
        D.read_json(spark, str(tmp_path), D.STRUCTURED, required=True, name="structured.json").collect()


def test_roots_and_review_defaults(spark, tmp_path):
    put(f"{tmp_path}/new/j/structured.json", {**DOC, "chapter": "new"})
    put(f"{tmp_path}/old/j/structured.json", {**DOC, "chapter": "old"})
    put(f"{tmp_path}/old/k/structured.json", {**DOC, "chapter": "only"})
    got = D.read_roots(spark, [f"{tmp_path}/new", f"{tmp_path}/old"], D.STRUCTURED, name="structured.json")
    assert {(r.job, r.chapter) for r in got.collect()} == {("j", "new"), ("k", "only")}
    put(f"{tmp_path}/r/review.json", {"document": {"exam": " board "}})
    r = D.read_review(spark, f"{tmp_path}/r").first()
    assert r.document.exam == "BOARDS" and r.questions == {} and r.addedQuestions == []


def test_ocr_cache_files_and_settings(spark, tmp_path, monkeypatch):
    put(f"{tmp_path}/o/job/ocr_p003.json", {"text": [[1.0, 2.0, 3.0, 4.0, "word"]], "regions": [["p003_ocr000.png", 5.0, 6.0, 7.0, 8.0]]})
    t = {r.kind: r for r in D.read_ocr_pages(spark, f"{tmp_path}/o").collect()}
    assert (t["text"].value, t["text"].page, t["text"].x0, t["text"].bottom) == ("word", 3, 3.0, 2.0)
    assert (t["eq"].value, t["eq"].x0, t["eq"].top, t["eq"].x1) == ("p003_ocr000.png", 5.0, 6.0, 7.0)
    put(f"{tmp_path}/p/Class 9/Maths/Chapter 01 - Sums.pdf", "%PDF-1.4 x")
    put(f"{tmp_path}/p/other/Maths/b.pdf", "no")
    f = {r.name: r for r in D.read_pdfs(spark, f"{tmp_path}/p").collect()}
    assert f["b.pdf"].is_pdf is False and f["Chapter 01 - Sums.pdf"].is_pdf is True
    b = {r.chapter: r for r in D.book_parts(spark.createDataFrame([("x/Class 9/Maths/Chapter 01 - Sums.pdf",), ("x/other/Maths/b.pdf",)], "path string")).collect()}
    assert b["Sums"].className == "Class 9" and b["b"].className is None
    put(f"{tmp_path}/env", "# c\nQM_A=1\nexport QM_B='two'\nbad line\n")
    monkeypatch.setenv("QM_A", "own")
    monkeypatch.delenv("QM_B", raising=False)
    assert D.settings(f"{tmp_path}/env") == {"QM_A": "1", "QM_B": "two"} and os.environ["QM_A"] == "own" and os.environ["QM_B"] == "two"


def test_bundle_reports_missing_and_drops_stale(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    os.makedirs(src)
    os.makedirs(out / "images")
    (src / "a.png").write_bytes(b"a")
    (out / "images" / "stale.png").write_bytes(b"s")
    r = spark.sql("select 'q' as id, array(named_struct('url', 'images/a.png'), named_struct('url', 'images/b.png'), named_struct('url', 'x/a.png')) as imageCrops")
    got = sinks.bundle(r, str(src), str(out))
    assert (got["questions"], got["images"]) == (1, 1) and [r.name for r in got["missing"].collect()] == ["b.png"] and os.listdir(out / "images") == ["a.png"]
    assert sinks.bundle(r.limit(0), str(src), str(out))["images"] == 0 and os.listdir(out / "images") == []
    assert sinks.zip_files(["images/a.png", "a.png", "b.png"], str(src), str(tmp_path / "z.zip")) == 1


def test_put_objects_and_versions(spark, tmp_path):
    store = str(tmp_path / "store")
    os.makedirs(store)
    n = spark.createDataFrame([("a.png", "o1"), ("none.png", "o2")], "file string, object string")
    read = lambda f: b"x" if f == "a.png" else None
    exists = lambda o: os.path.exists(f"{store}/{o}")

    def write(o, data):
        with open(f"{store}/{o}", "wb") as f:
            f.write(data)

    run = lambda w: {r.object: r.outcome for r in sinks.put_objects(n, read, exists, write, w).collect()}
    assert run(False) == {"o1": "stored", "o2": "missing"} and os.listdir(store) == []
    assert run(True)["o1"] == "stored" and run(True)["o1"] == "reused"
    p = sinks.write_version(spark.range(3), f"{tmp_path}/t", 1)
    assert spark.read.parquet(p).count() == 3 and spark.read.json(f"{tmp_path}/t/current").first().version == 1
    sinks.write_records(spark.sql("select 'd' as documentId, cast(null as string) as x"), f"{tmp_path}/rec")
    assert spark.read.json(f"{tmp_path}/rec").columns == ["x", "documentId"]
    e = sinks.ensure(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int"), "k")
    assert {(r.k, r.v) for r in e.collect()} == {("a", 1), ("b", 2)}
    assert spark.sql("select ' JEE ' as e, '' as s, null as m, 'C' as c").select(sinks.drive_path("e", "s", F.col("m").cast("string"), "c").alias("p")).first().p == "JEE/C"


def test_queue_runs_in_order_and_survives_failures(spark, tmp_path):
    for i, (k, p) in enumerate([("up", "x"), ("bad", "y"), ("odd", "z"), ("up", "w")]):
        put(f"{tmp_path}/in/{i}.json", {"job_id": f"j{i}", "kind": k, "payload": p, "queued_at": f"2024-01-01T00:00:0{i}"})
        os.utime(f"{tmp_path}/in/{i}.json", (1000 + i, 1000 + i))

    def bad(b):
        return b.withColumn("result", F.raise_error(F.lit("broken")))

    hs = {"up": lambda b: b.withColumn("result", F.upper("payload")), "bad": bad}
    run = lambda: J.run_queue(J.read_jobs(spark, f"{tmp_path}/in"), hs, f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    run()  # a restart finds nothing to do
    got = {r.job_id: (r.batch, r.status, r.result) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["j0"] == (0, "done", "X") and got["j3"] == (3, "done", "W")
    assert got["j1"][1] == "error" and got["j2"] == (2, "error", "no handler for odd")


def test_states_batch_and_stream(spark, tmp_path):
    ev = [("a", "queued", "2024-01-01T00:00:00"), ("a", "done", "2024-01-01T00:00:09"), ("b", "running", "2024-01-01T00:00:05"), ("a", "running", "2024-01-01T00:00:04")]
    for i, (j, s, t) in enumerate(ev):
        put(f"{tmp_path}/ev/{i}.json", {"job_id": j, "status": s, "at": t})
        os.utime(f"{tmp_path}/ev/{i}.json", (1000 + i, 1000 + i))
    batch = J.latest_status(spark.read.schema(J.EVENT).json(f"{tmp_path}/ev"))
    want = {"a": "done", "b": "running"}
    assert {r.job_id: r.status for r in batch.collect()} == want
    J.keep_status(J.read_jobs(spark, f"{tmp_path}/ev", J.EVENT), f"{tmp_path}/st", f"{tmp_path}/cp2")
    assert {r.job_id: r.status for r in J.status_table(spark, f"{tmp_path}/st").collect()} == want
    J.keep_status(J.read_jobs(spark, f"{tmp_path}/ev", J.EVENT), f"{tmp_path}/st2", f"{tmp_path}/cp4", compact=3)
    assert os.path.isdir(f"{tmp_path}/st2-states/upto=2") and {r.job_id: r.status for r in J.status_table(spark, f"{tmp_path}/st2").collect()} == want
    asked = spark.createDataFrame([("a",), ("b",)], "job_id string")
    assert [r.job_id for r in J.refused_deletions(asked, batch).collect()] == ["b"]


def test_stream_duplicates(spark, tmp_path):
    for i, sha in enumerate(["x", "y", "x"]):
        put(f"{tmp_path}/up/{i}.json", {"sha": sha, "at": f"2024-01-01T00:0{i}:00"})
    s = J.without_repeats(spark.readStream.schema("sha string, at timestamp").json(f"{tmp_path}/up"))
    s.writeStream.format("memory").queryName("ups").option("checkpointLocation", f"{tmp_path}/cp3").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sha for r in spark.table("ups").collect()) == ["x", "y"]


def test_written_tables_are_discarded(spark):
    from quillmark.runtime import discard, file_system, scratch, written

    a, b = written(spark.range(5)), written(spark.range(3))
    at = scratch(spark, "own")
    spark.range(2).write.parquet(at)
    there = lambda p: file_system(spark, p)[0].exists(file_system(spark, p)[1])
    assert a.count() == 5 and b.count() == 3
    discard(a)
    assert not there(a._written_at) and there(b._written_at) and there(at) and b.count() == 3
    discard(spark.range(1), a)
    discard()
    assert not there(b._written_at) and not there(at)
