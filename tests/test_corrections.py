"""Corrections, packages and files, on small cases."""

from __future__ import annotations

import hashlib
import zipfile
from io import BytesIO

import pytest

from quire.functions import text
from quire.operators import corrections as cor
from quire.operators import export, workflow, xhtml
from quire.sources import epub, markup, projects, standalone
from quire.streaming import cursor


def items(spark, rows):
    return spark.createDataFrame([(1, k, a, "e", f) for k, (a, f) in enumerate(rows)], "source_id long, item long, action string, evidence string, fields map<string,string>")


def nothing(spark):
    return cor.Corrections(*[spark.createDataFrame([], s) for s in ("source_id long, key string, level long", "source_id long, key string", "source_id long, gid long, title string, level long, offset long", "source_id long, shard_ord long, page_idx long, printed long")])


def test_the_last_item_decides(spark):
    rows = [("level", {"key": "07", "level": "3"}), ("level", {"key": "7", "level": "4"}), ("level", {"key": "8", "level": "2"}), ("level-clear", {"key": "8"}), ("add", {"gid": "5", "title": " t ", "level": "2"}), ("levels", {"pairs": '{"add:5": 6}'}),
            ("delete", {"key": "add:5"}), ("delete", {"key": "9"}), ("anchor", {"shard": "P2", "page_idx": "0", "printed": "10"}), ("level", {"key": "1", "level": "10"}), ("add", {"gid": "toc:1", "title": "x", "level": "1"})]
    after, failed = cor.applied(nothing(spark), items(spark, rows))
    assert [tuple(r) for r in after.levels.collect()] == [(1, "7", 4)] and [tuple(r) for r in after.deleted.collect()] == [(1, "9")]
    assert after.added.count() == 0 and [tuple(r) for r in after.anchors.collect()] == [(1, 2, 0, 10)]
    assert {(r["item"], r["error"]) for r in failed.collect()} == {(9, "level out of range"), (10, "no block number")}


def test_a_preview_with_a_bad_item_changes_nothing(spark):
    states = spark.createDataFrame([(1, "p", "ready")], "source_id long, preview_id string, state string")
    after, outcome = cor.apply_previews(nothing(spark), items(spark, [("level", {"key": "1", "level": "2"}), ("level", {"key": "2", "level": "0"})]), states)
    assert outcome.first()["outcome"] == "rolled back" and after.levels.count() == 0


def test_files_are_written_once_and_inside(spark, tmp_path):
    files = spark.createDataFrame([(1, "a/b.md", "é text"), (2, "c.md", "")], "source_id long, path string, content string")
    got = {(r["source_id"], r["path"]): (r["bytes"], r["sha256"]) for r in workflow.write_files(files, f"file://{tmp_path}/out").collect()}
    assert (tmp_path / "out/1/a/b.md").read_text() == "é text" and (tmp_path / "out/2/c.md").read_text() == ""
    assert got[1, "a/b.md"] == (7, hashlib.sha256("é text".encode()).hexdigest())
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["b.md", "c.md"]
    with pytest.raises(Exception, match="lies outside"):
        workflow.write_files(files.selectExpr("source_id", "'../x' path", "content"), f"file://{tmp_path}/out")


def test_sections_by_block_type(spark):
    rows = [
        ("text", "A line", "", "", [], []), ("text", "  ", "", "", [], []), ("table", "", "", "<table><tr><td>1</td></tr></table>", ["T 1"], ["of it"]), ("image", "", "a/b/c.png", "", ["P", "Q"], []), ("chart", "", "", "", [], []),
        ("page_footnote", "n 1", "", "", [], []), ("equation", "", "", "", [], []), ("list", "", "", "", [], []), ("header", "H", "", "", [], []), ("page_footnote", "n 2", "", "", [], []),
    ]
    blocks = spark.createDataFrame([(1, 0, k, 0, 1, 0 if k < 9 else 1, "<!-- p=1 -->", *r) for k, r in enumerate(rows)], "source_id long, file long, gid long, part int, shard_ord long, page_idx long, anchor string, type string, text string, img_path string, table_body string, caption array<string>, footnote array<string>")
    show = lambda how: export.documents(export.rendered_lines(blocks, how)).first()["content"].split("\n")
    body = ["<!-- p=1 -->", "A line", "**T 1**", "<table><tr><td>1</td></tr></table>", "> of it", "![P；Q](images/c.png)", "*P；Q*", "![]()"]
    assert show("page-end") == [*body, "", "", "**脚注**（P1 物理页 0）：", "- n 1", "<!-- p=1 -->", "", "**脚注**（P1 物理页 1）：", "- n 2"]
    assert show("inline") == [*body, "<!-- footnote --> n 1", "", "<!-- p=1 -->", "<!-- footnote --> n 2"]
    assert show("drop") == [*body, "", "<!-- p=1 -->"]


def test_bodies_are_well_formed():
    import xml.etree.ElementTree as ET

    for line in ("**a *b** c*", "x <sup>2", "a<b & c", "`x` ** * **", "***", "| a | b |\n|---|---|\n| 1 |", "> q\n> r", "* one\n* two", "<table><tr><td>x<td>y</table>", "![c](images/a%20b.png)", "\x0b\x01"):
        ET.fromstring(f'<body xmlns:epub="x">{xhtml.body(line)}</body>')
    assert xhtml.body("# T\n\nT\n\ntext", "T") == "<p>text</p>"
    assert xhtml.body("![c](http://x/y.png)") == "<p>c</p>"


def test_packages_hold_what_sections_show(spark):
    sections = spark.createDataFrame([(1, 0, "One", 1, "![c](images/a.png)\n*c*\n![d](images/gone.png)"), (1, 1, "Two", 2, "text")], "source_id long, ord long, title string, level long, text string")
    images = spark.createDataFrame([(1, "images/a.png", bytearray(b"png"))], "source_id long, path string, image binary")
    covers = spark.createDataFrame([(1, "image/jpeg", bytearray(b"jpg"))], "source_id long, media_type string, image binary")
    books = epub.write_books(sections, images, covers)
    r = books.first()
    content = bytes(r["content"])
    assert epub.problems(content, 2) == [] and r["images"] == 1 and r["sha256"] == hashlib.sha256(content).hexdigest()
    with zipfile.ZipFile(BytesIO(content)) as z:
        assert z.namelist()[0] == "mimetype" and z.read("OEBPS/images/a.png") == b"png" and "[图片缺文件：d]" in z.read("OEBPS/text/ch001.xhtml").decode()
        assert '<meta name="dtb:depth" content="2"/>' in z.read("OEBPS/toc.ncx").decode()
    assert [tuple(x) for x in epub.covers(books).select("how", "path", "size").collect()] == [("properties", "OEBPS/images/cover.jpg", 3)]
    assert content == bytes(epub.write_books(sections, images, covers).first()["content"])


def test_nested_texts():
    assert projects.nested_text(["a ", ["b", {"text": "c", "list_items": ["d", "", None]}], {"text": "x y", "list_items": ["x", "y"]}]) == "a\nb\nc\nd\nx y"
    with pytest.raises(ValueError):
        projects.nested_text([1])


def test_paragraph_rules_are_the_same_in_both_forms(spark):
    texts = ["", "short", "a longer text that goes on", "it ends here.", "an open (bracket here.", "“quote", "and then，", "①note", "F12 text", "`F7` 文字", "【x】结束。", "12 numbers"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.is_cut("t"), text.is_surely_cut("t"), text.is_note("t"), text.goes_on("t"))
    for r in df.collect():
        t = r[0]
        assert tuple(r)[1:] == (markup.is_cut(t), markup.is_surely_cut(t), markup.is_note(t), markup.goes_on(t)), t


def plain_groups(files):
    groups = []

    def push(name, part):
        if groups and standalone._index(name) and standalone._index(groups[-1][0]):
            groups[-1] = (standalone.together(groups[-1][0], name), [*groups[-1][1], part])
        else:
            groups.append((name, [part]))

    for unit, label, starts, cut, cut_title, n in files:
        head = (unit, 0, n if cut is None else cut)
        if starts or not groups:
            push(label, head)
        else:
            groups[-1][1].append(head)
        if cut is not None:
            push(cut_title, (unit, cut, n))
    return [(k + 1, title, *p) for k, (title, parts) in enumerate(groups) for p in parts]


def test_chapters_of_files(spark):
    files = [(0, "封面", False, None, None, 2), (1, "第一章", True, None, None, 5), (2, "x", False, 3, "人名索引", 6), (3, "地名", True, None, None, 4), (4, "关键词", True, None, None, 1), (5, "后记", True, 2, "索引", 3)]
    df = spark.createDataFrame([(1, *f) for f in files], "source_id long, unit long, label string, starts boolean, cut long, cut_title string, n long")
    got = sorted((r["chapter"], r["title"], r["unit"], r["first"], r["past"]) for r in standalone.chapter_groups(df).collect())
    assert got == plain_groups(files) and any(t == "索引 人名索引·地名·关键词" for _, t, *_ in got)


def test_chapter_texts(spark):
    items_ = [(0, "h1", "第一章 标题①"), (1, "h2", "节"), (2, "p", "a\nb"), (3, "note", "① n\nm"), (4, "tr", "x | y"), (5, "li.p", "one\n two"), (6, "hr", ""), (7, "edge", "F1")]
    df = spark.createDataFrame([(1, 0, k, kind, t, False) for k, kind, t in items_], "source_id long, unit long, ord long, kind string, text string, quoted boolean")
    groups = spark.createDataFrame([(1, 1, "第一章标题①", 0, 0, 8)], "source_id long, chapter long, title string, unit long, first long, past long")
    assert standalone.chapter_texts(df, groups).first()["content"] == "# 第一章 标题\n\n## 节\n\na\nb\n\n> ① n\n> m\n\n| x | y |\n- one two\n---\n\n`F1`\n"


def test_events_are_told_once_however_late(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string"
    source = f"file://{tmp_path}/in"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        cursor.told(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["job_id"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, 7, "click"), (2, 7, "view"), (3, 8, "click")])
    assert run() == [(7, 1), (8, 3)]
    put([(1, 7, "click"), (2, 7, "click"), (4, 7, "click"), (5, 9, "view")])
    assert run() == [(7, 1), (7, 4), (8, 3)]
