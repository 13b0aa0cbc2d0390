"""Table functions, sources, sinks, streams and the command line on Spark."""

from __future__ import annotations

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheaf import api, formats
from sheaf.__main__ import main
from sheaf.functions import text, udf
from sheaf.operators import tables
from sheaf.plans import ORACLES, QUERIES
from sheaf.plans.synthetic import zipped
from sheaf.sources import files, sinks
from sheaf.streaming import landing

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows) -> list:
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got[sorted(got.columns)]) == shown(want[sorted(want.columns)])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "markdown"] and df.count() == 50


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / "a.html").write_text("<h1>A</h1>")
    (root / "sub" / "b.txt").write_text("B")
    (root / "c.zip").write_bytes(zipped([("d.txt", b"D"), ("e.html", b"<b>E</b>")]))
    (root / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    return root


def test_files_source(spark, folder):
    found = files.read_files(spark, str(folder)).select("name", "length")
    assert {r.name for r in found.collect()} == {"a.html", "b.txt", "c.zip", "bad.pdf"}
    plan = files.read_files(spark, str(folder)).where("length > 3").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,3)" in plan and "content" not in plan.split("ReadSchema")[-1]
    assert files.dealt_by_size(files.read_files(spark, str(folder))).count() == 4


def test_pages_and_members(spark, folder):
    found = files.read_files(spark, str(folder))
    pages = tables.document_pages(found.where("name <> 'c.zip'"), name="name", keep=["path"])
    by = {r.path.rpartition("/")[2]: r for r in pages.collect()}
    assert by["a.html"].text == "# A\n\n" and by["b.txt"].page_number == 0 and by["bad.pdf"].error and by["bad.pdf"].text is None
    members = tables.archive_members(found.where("name = 'c.zip'"), name="name", keep=["name"])
    assert sorted((r.member_path, r.markdown) for r in members.collect()) == [("d.txt", "D"), ("e.html", "**E**")]
    with pytest.raises(Exception, match="no pages|archive input"):
        tables.document_pages(found, name="name", mode="FAILFAST").collect()
    with pytest.raises(ValueError, match="text"):
        tables.document_pages(found.withColumn("text", F.lit(1)), keep=["text"])


def test_same_over_any_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("content"))
    one, many = (sorted(map(str, tables.document_pages(pages.repartition(n), keep=["page_id"]).collect())) for n in (1, 9))
    assert one == many


def test_documents_source(spark, folder):
    files.register(spark)
    read = spark.read.format("documents").option("path", str(folder))
    rows = {r.name: r for r in read.load().collect() if r.error is None}
    assert rows["a.html"].text == "# A\n\n" and rows["b.txt"].text == "B"
    assert [r.name for r in read.load().where("name = 'a.html'").collect()] == ["a.html"]
    assert {r.name: r.format for r in read.option("header_only", "true").load().collect()}["bad.pdf"] == "PDF"


def test_documents_stream(spark, folder, tmp_path):
    files.register(spark)
    stream = spark.readStream.format("documents").option("path", str(folder)).option("glob", "*.html").load()
    q = stream.writeStream.format("memory").queryName("landed_pages").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.text for r in spark.table("landed_pages").collect()] == ["# A\n\n"]


def test_landing_stream_as_batch(spark, folder, tmp_path):
    (folder / "copy.html").write_text("<h1>A</h1>")
    streamed = landing.run_available(landing.landed_documents(spark, str(folder)), f"file://{tmp_path}/run", mode="append")
    rows = streamed.collect()
    os.remove(folder / "copy.html")
    assert len(rows) == len({r.digest for r in rows}) and "# A\n\n" in {r.converted.markdown for r in rows}


def test_image_names_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", "i", "jpeg", 1), ("f", "i", "jpeg", 2), ("g", "i", "jpeg", 3), ("f", "i", "png", 4)], "folder string, name string, format string, n int")
    assert {r.n: r.file_name for r in sinks.named_images(df).collect()} == {1: "i.jpg", 2: "i_1.jpg", 3: "i.jpg", 4: "i.png"}
    members = spark.createDataFrame([("a", "x", None), ("b", None, "bad")], "member_path string, markdown string, error string")
    assert sinks.exit_code(members).first().exit_code == 2 and sinks.exit_code(members.limit(1).where("error IS NULL")).first().exit_code in (0, None)
    texts = members.select(sinks.member_text(F.col("member_path"), F.col("markdown"), F.col("error")).alias("t")).collect()
    assert [r.t for r in texts] == ["=== a ===\nx\n\n", "=== b — ERROR: bad ===\n\n"]
    sinks.write_markdown(members.where("markdown IS NOT NULL"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "x"


CASES = [(b"", "a.pdf"), (b"", ""), (b"%PDF", "x"), (b"hello", "noext"), (b"<x", ""), (b"<!doctype HTML><p>a", ""), (b"\0", "a.dxf"), (b"\0", "q"), ("é".encode() * 5000, ""), (b"a" * 8191 + "é".encode(), ""), (b"AC1032\0", ""), (b"BM not a picture", "t"), (b"x", "d.dwg"), (b"{\\rtf1 abc}", "x"), (b"\xff\xfe", "x.bin")]


def test_native_detection_as_on_bytes(spark):
    df = spark.createDataFrame([(n, bytearray(c), s) for n, (c, s) in enumerate(CASES)], "n int, c binary, s string")
    rows = df.select("n", formats.detect_native(F.col("c"), F.col("s")).alias("native"), udf.detect(F.col("c"), F.col("s")).alias("opened")).collect()
    assert {r.n: r.native for r in rows} == {r.n: r.opened for r in rows} == {n: formats.detect_bytes(c, s) for n, (c, s) in enumerate(CASES)}


def test_no_python_for_native_functions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select(text.strip_markdown(F.col("text")), formats.detect_native(F.col("text").cast("binary"), F.lit("a")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_conversion_reads_only_its_column(spark):
    plan = QUERIES["html_to_markdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "Exchange" not in plan


def test_api_and_command_line(folder, capsys):
    assert api.convert(str(folder / "a.html")) == "# A\n\n" and api.convert(str(folder / "a.html"), format="text") == "A\n\n"
    assert [p.page_number for p in api.stream_pages(str(folder / "a.html"))] == [1]
    assert api.detect(str(folder / "c.zip"))["category"] == "archive" and api.detect("/nowhere/x.pdf")["format"] == "PDF" and api.is_archive_file(str(folder / "c.zip"))
    assert main([str(folder / "a.html")]) == 0 and capsys.readouterr().out == "# A\n\n"
    assert main([str(folder / "a.html"), "--chunks"]) == 0 and capsys.readouterr().out.startswith("=== Page 1 (0x0, body=0.0pt) ===")
    assert main([str(folder / "c.zip")]) == 0 and "=== d.txt ===\nD\n" in capsys.readouterr().out
    assert main([str(folder / "a.html"), "--detect"]) == 0 and json.loads(capsys.readouterr().out)["format"] == "HTML"
    assert main([str(folder / "bad.pdf")]) == 1


def test_images_are_written(spark, tmp_path, folder):
    import base64
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 80)
    page = f'<img src="data:image/png;base64,{base64.b64encode(png).decode()}">'
    df = spark.createDataFrame([("a", bytearray(page.encode())), ("b", bytearray((page * 2).encode()))], "folder string, content binary")
    found = tables.document_images(df.withColumn("label", F.lit("a.html")), name="label", keep=["folder"])
    assert sinks.write_images(sinks.named_images(found), f"file://{tmp_path}/out") == 3
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.png")) == ["a/page1_img0.png", "b/page1_img0.png", "b/page1_img1.png"]
    (tmp_path / "p.html").write_text(page)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "page1_img0.png").write_bytes(b"taken")
    assert api.convert(str(tmp_path / "p.html"), image_dir=str(tmp_path / "i")) == "![image](page1_img0_1.png)"
    assert (tmp_path / "i" / "page1_img0_1.png").read_bytes() == png


def test_pdf_round_trip_of_whole_turns(spark):
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s", ""), "[^ -~]", "x")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit("T"), t["turn"].cast("string"), t["text"], F.lit("z")))
    want = spark.read.parquet(f"{SF}/conversations.parquet").groupBy("conv_id").agg(bare(F.array_join(turns, "")).alias("t"))
    got = entry.queries()["pdf_roundtrip_whole_text"](spark, SF).select("conv_id", bare("lines").alias("t"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
