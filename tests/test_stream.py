"""Streams agree with batches; a batch that runs again changes nothing."""

import os

from drawkit import fixtures as X
from drawkit.operators import catalog, segments
from drawkit.queries import library
from drawkit.sources import files as S
from drawkit.streaming import ingest as I
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def forget_commit(checkpoint):
    """As if the driver had died after the last batch was written, and before that was noted."""
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")


def upload(spark, rows):
    ddl = "drawing_id long, path string, filename string, uploaded string, content string, tech_text string"
    df = spark.createDataFrame(rows, ddl).withColumns({"original_filename": F.lit(None).cast("string"), "uploaded": F.col("uploaded").cast("timestamp"), "content": F.col("content").cast("binary"), "title_text": F.lit(""), "all_text": F.lit("视图")})
    return df.select(*spark.createDataFrame([], I.UPLOAD).columns)


def test_ingest_takes_each_version_once(spark, tmp_path):
    args = (spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/cp")
    pdf = "%PDF-"
    deliveries = [
        [(1, "a", "1.pdf", "2024-01-01", pdf + "x", "1. 一"), (2, "b", "2.docx", "2024-01-01", pdf, "1. 二"), (3, "c", "3.pdf", "2024-01-01", "junk", "1. 三"), (4, "d", "4.png", "2024-01-01", None, "1. 四")],
        [(1, "e", "1.pdf", "2024-01-02", pdf + "x", "1. 一"), (3, "f", "3.pdf", "2024-01-02", pdf, "1. 三"), (5, "g", "5.pdf", "2024-01-02", pdf + "old", "1. 旧"), (5, "h", "5.pdf", "2024-01-03", pdf + "new", "1. 新")],
        [(1, "i", "1.pdf", "2024-01-04", pdf + "y", "1. 一 \n2. 又"), (5, "j", "5.pdf", "2024-01-01", pdf + "late", "1. 晚")],
        [(1, "k", "1.pdf", "2024-01-05", pdf + "x", "1. 一")],
    ]
    for i, rows in enumerate(deliveries):
        upload(spark, rows).write.parquet(f"{tmp_path}/in/{i}")
        I.ingest(*args).awaitTermination()
    decided = {(r.path, r.action, r.reject_reason) for r in spark.read.parquet(f"{tmp_path}/out/uploads").collect()}
    assert decided == {
        ("a", "new", None), ("b", "rejected", "unsupported type"), ("c", "rejected", "not a PDF"), ("d", "rejected", "empty"),
        ("e", "known", None), ("f", "new", None), ("h", "new", None), ("i", "changed", None), ("j", "known", None), ("k", "changed", None),
    }
    last = upload(spark, [deliveries[3][0], deliveries[1][1], deliveries[1][3]])
    want = segments.segments(last.select("drawing_id", "title_text", "tech_text", "all_text"))
    got = I.current(spark, f"{tmp_path}/out")
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    before, files = rows_of(got), sorted(os.listdir(f"{tmp_path}/out/segments"))
    forget_commit(f"{tmp_path}/cp")
    I.ingest(*args).awaitTermination()
    assert rows_of(I.current(spark, f"{tmp_path}/out")) == before and sorted(os.listdir(f"{tmp_path}/out/segments")) == files


def test_a_drawing_is_forgotten_after_its_time(spark, tmp_path):
    for i, (drawing, day) in enumerate([(1, "2024-01-01"), (2, "2024-03-01"), (3, "2024-03-02"), (1, "2024-03-03"), (2, "2024-03-04")]):
        upload(spark, [(drawing, f"p{i}", "x.pdf", day, "%PDF-", "")]).write.parquet(f"{tmp_path}/in/{i}")
        I.ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/cp", remember="10 days").awaitTermination(120)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/uploads").select("path", "action")) == [("p0", "new"), ("p1", "new"), ("p2", "new"), ("p3", "new"), ("p4", "known")]


def test_drawings_share_states(spark, tmp_path):
    """What is decided doesn't depend on the number of states; large ids and drawings without one keep apart."""
    big, pdf = (1 << 53) + 1, "%PDF-"
    deliveries = [
        [(1, "a", "1.pdf", "2024-01-01", pdf, "1. 一"), (2, "b", "2.pdf", "2024-01-01", pdf, "1. 二"), (big, "c", "c.pdf", None, pdf, "1. 三"), (big - 1, "d", "d.pdf", "2024-01-01", pdf + "d", ""), (None, "e", "e.pdf", "2024-01-01", pdf + "e", "")],
        [(1, "f", "1.pdf", "2024-01-02", pdf, "1. 一"), (1, "g", "1.pdf", "2024-01-03", "junk", ""), (2, "h", "2.pdf", "2024-01-02", pdf + "2", "1. 二"), (2, "i", "2.pdf", None, pdf, "1. 二"), (big, "j", "c.pdf", "2024-01-02", pdf, "1. 三"), (None, "k", "e.pdf", "2024-01-02", pdf + "e", ""), (3, "l", "3.pdf", "2024-01-02", pdf, "")],
        [(2, "m", "2.pdf", "2024-01-02", pdf, "1. 二"), (big - 1, "n", "d.pdf", "2023-12-31", pdf, ""), (3, "o", "3.pdf", "2024-01-03", pdf, "")],
    ]
    want = {("a", "new"), ("b", "new"), ("c", "new"), ("d", "new"), ("e", "new"), ("f", "known"), ("g", "rejected"), ("h", "changed"), ("j", "known"), ("k", "known"), ("l", "new"), ("m", "changed"), ("n", "known"), ("o", "known")}
    for i, rows in enumerate(deliveries):
        upload(spark, rows).write.parquet(f"{tmp_path}/in/{i}")
    for groups in (1, I.GROUPS):
        at = f"{tmp_path}/{groups}"
        for i in range(len(deliveries)):
            spark.read.parquet(f"{tmp_path}/in/{i}").write.parquet(f"{at}/in/{i}")
            stream = I.ingest(spark, f"{at}/in/*", f"{at}/out", f"{at}/cp", groups=groups)
            stream.awaitTermination()
        got = spark.read.parquet(f"{at}/out/uploads")
        assert {(r.path, r.action) for r in got.collect()} == want
        assert {r.drawing_id for r in got.where("path in ('c', 'd', 'e')").collect()} == {big, big - 1, None}
        states = stream.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert states == 2 if groups == 1 else states > 2  # one for drawings without an id


def test_a_rejected_upload_keeps_no_drawing_in_mind(spark, tmp_path):
    for i, (drawing, day, content) in enumerate([(1, "2024-01-01", "%PDF-"), (1, "2024-01-02", "junk"), (2, "2024-03-01", "%PDF-"), (3, "2024-03-02", "%PDF-"), (1, "2024-03-03", "%PDF-")]):
        upload(spark, [(drawing, f"p{i}", "x.pdf", day, content, "")]).write.parquet(f"{tmp_path}/in/{i}")
        I.ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/cp", remember="10 days").awaitTermination(120)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/uploads").select("path", "action")) == [("p0", "new"), ("p1", "rejected"), ("p2", "new"), ("p3", "new"), ("p4", "new")]


def test_stream_and_batch_admit_and_sign_alike(spark):
    rows, _ = library.uploads(spark, SF)
    judged = {(r.path, r.signature, r.reject_reason) for r in I.judge(rows, "1", "", 10).collect()}
    reasons = {r.path: r.reject_reason for r in S.admission(rows.withColumn("length", F.length("content"))).collect()}
    files = rows.select("filename", "content")
    signed = {r.drawing_id: r.signature for r in S.content_signature(rows.withColumnRenamed("drawing_id", "id").drop("content"), files, "1", "", 10).collect()}
    assert judged == {(p, signed[int(p[2:])], reasons[p]) for p in reasons}


def test_progress_is_a_table_that_batches_merge_into(spark, tmp_path):
    rows = X.outcomes(spark, SF).select("batch_id", "ok", F.pmod(F.xxhash64("filename"), F.lit(2)).alias("part"))
    path, cp = f"{tmp_path}/status", f"{tmp_path}/cp"
    schema = rows.drop("part").schema

    def run():
        I.batch_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), path, cp).awaitTermination()

    for part in range(2):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{tmp_path}/in/{part}")
        run()
    want = rows_of(catalog.batch_status(rows).withColumn("batch_id", F.col("batch_id").cast("string")))
    assert rows_of(I.progress(spark, path)) == want
    versions = sorted(os.listdir(f"{path}/versions"))
    forget_commit(cp)
    run()
    assert rows_of(I.progress(spark, path)) == want and sorted(os.listdir(f"{path}/versions")) == versions
    assert {r.status for r in I.progress(spark, path).collect()} <= {"completed", "partial", "failed"}
