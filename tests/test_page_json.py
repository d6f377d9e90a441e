import json

from lexmill.operators.structure import build_markdown, page_items
from lexmill.sources import read_page_json, read_page_lines

HEADING = {"type": "heading", "value": "1. Start", "md": "", "bBox": {"h": 20.0}, "more": [1]}
TEXT = {"type": "text", "value": "Words.", "md": ""}


def test_files_are_read_or_say_why_not(spark, tmp_path):
    whole = json.dumps({"pages": [{"items": [HEADING, TEXT]}, {"page": 2}, {"items": [TEXT]}], "job": "x"})
    written = {
        "good.json": whole, "cut.json": whole[:-5], "empty.json": "", "blank.json": " \n", "none.json": '{"pages": []}', "other.json": "{}", "null.json": "null", "shape.json": '{"pages": [{"items": "x"}]}',
        "list.json": "[1]", "large.json": json.dumps({"pages": [], "x": "y" * 3000}), "notes.txt": whole,
    }
    (tmp_path / "deep").mkdir()
    for name, text in written.items():
        (tmp_path / "deep" / name).write_text(text)
    (tmp_path / "bytes.json").write_bytes(b'{"pages": [{"items": [{"value": "\xff"}]}]}')
    rows = read_page_json(spark, str(tmp_path), most=2000).cache()
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.doc is None) for r in rows.collect()}
    assert got == {
        "good.json": (None, False), "cut.json": ("not JSON", True), "blank.json": ("empty", True), "none.json": ("no pages", True), "other.json": ("no pages", True), "null.json": ("unexpected shape", True),
        "shape.json": ("unexpected shape", True), "list.json": ("unexpected shape", True), "large.json": ("too large", True), "bytes.json": ("not UTF-8", True),
    }
    good = rows.where("error is null").selectExpr("path as doc", "doc.pages as pages")
    assert build_markdown(page_items(good)).first().markdown == "# 1. Start\nWords.\n\nWords.\n"


def test_filters_and_columns_reach_the_listing(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    plan = read_page_json(spark, str(tmp_path), most=2000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,2000)" in plan and "GreaterThan(length,2000)" in plan
    sizes = read_page_json(spark, str(tmp_path)).select("path", "size")
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<path:string,length:bigint>") == 2 and sizes.first().size == 2
    (tmp_path / "none").mkdir()
    assert read_page_json(spark, str(tmp_path / "none")).collect() == []


def test_lines_are_read_or_say_why_not(spark, tmp_path):
    whole = json.dumps({"pages": [{"items": [HEADING, TEXT]}, {"page": 2}, {"items": [TEXT]}], "tab": "a\tb"})
    written = {
        "good": whole, "cut": whole[:-5], "none": '{"pages": []}', "other": "{}", "shape": '{"pages": [{"items": "x"}]}', "blank": " \t ", "empty": "", "large": json.dumps({"pages": [], "x": "y" * 3000}),
    }
    (tmp_path / "lines.txt").write_text("".join(f"{k}\t{v}\n" for k, v in written.items()))
    with (tmp_path / "more.txt").open("wb") as out:
        out.write(b'bytes\t{"pages": [{"items": [{"value": "\xff"}]}]}\n')
    rows = read_page_lines(spark, str(tmp_path), most=2000).cache()
    got = {r.doc_id: (r.error, r.doc is None) for r in rows.collect()}
    assert got == {
        "good": (None, False), "cut": ("not JSON", True), "none": ("no pages", True), "other": ("no pages", True), "shape": ("unexpected shape", True), "blank": ("empty", True), "empty": ("empty", True), "large": ("too large", True),
        "bytes": ("not UTF-8", True),
    }
    assert {r.doc_id: r.size for r in rows.collect()}["good"] == len(whole)
    good = rows.where("error is null").selectExpr("doc_id as doc", "doc.pages as pages")
    assert build_markdown(page_items(good)).first().markdown == "# 1. Start\nWords.\n\nWords.\n"


def test_pages_do_not_become_files_each(spark, monkeypatch):
    """The files written do not grow with the pages."""
    from lexmill.plans import text

    seen = []
    monkeypatch.setattr(text, "delete", lambda s, folder: seen.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).count()))
    rows = text.src_pages(spark, "/root/testdata/sf0.01").count()
    assert 0 < seen[0] <= rows / 10
