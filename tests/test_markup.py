from __future__ import annotations

import pyarrow as pa
import pytest

from quire.sources import epub, markup


def kinds(text: str) -> list[tuple[str, str]]:
    return [(i.kind, i.text) for i in markup.items(text)]


def test_blocks_of_a_body():
    got = kinds("<html><body><h1>A <i>b</i></h1><p>one<p>two<sup>3</sup><sub>x</sub></p><p>①note</p><p>F12</p><img src='a.png'/><blockquote><p>q</p></blockquote></body></html>")
    assert got == [("h1", "A *b*"), ("p", "one"), ("p", "two3"), ("note", "①note"), ("edge", "F12"), ("img", "a.png"), ("p", "q")]


def test_quotes_are_marked():
    assert [i.quoted for i in markup.items("<body><p>a</p><blockquote><p>b</p></blockquote></body>")] == [False, True]


def test_lists_and_tables():
    got = kinds("<body><ul><li>a<li>b</ul><ul style='list-style: none'><li>①n</li><li>c</li></ul><table><tr><th>x</th><th>y</th></tr><tbody><tr><td>1</td></tr></tbody></table></body>")
    assert got == [("li.p", "a"), ("li.p", "b"), ("note", "①n"), ("p", "c"), ("tr", "x | y"), ("tr", "---|---"), ("tr", "1 | ")]


def test_edges_in_a_div_and_skipped_tags():
    assert kinds("<body><div><p>F1</p><p>E2</p></div><script>x</script><div><p>t</p></div></body>") == [("edge", "F1 · E2"), ("p", "t")]


def test_unclosed_bold_swallows_later_paragraphs():
    assert len(kinds("<body><article><h1>t</h1><p><b>one<p>two<p>three</article></body>")) == 2


def test_end_tags_never_close_the_outermost():
    assert kinds("<body><p>a</p></body></div><p>b</p>") == [("p", "a"), ("p", "b")]


@pytest.mark.parametrize(("text", "cut"), [("短", False), ("这是一个没有结束的段落", True), ("这是一个完整的段落。", False), ("一个带(未闭括号的段落。", True)])
def test_cut_paragraphs(text, cut):
    assert markup.is_cut(text) is cut


def test_joining_hops_over_notes():
    row = lambda kind, text: {"kind": kind, "text": text}
    got = markup.joined([row("p", "这是一个没有结束的"), row("note", "①注"), row("p", "段落到此为止。"), row("p", "另一段。")])
    assert [(r["kind"], r["text"]) for r in got] == [("p", "这是一个没有结束的段落到此为止。"), ("note", "①注"), ("p", "另一段。")]


def test_joining_needs_a_reason():
    row = lambda text: {"kind": "p", "text": text}
    assert len(markup.joined([row("这是一个没有结束的"), row("段落到此为止。")])) == 2
    assert len(markup.joined([row("这是一个没有结束的，"), row("段落到此为止。")])) == 1


def book(**changes) -> bytes:
    return epub.written("T", "en", "urn:x", "2010-01-01T00:00:00Z", [epub.Section("One", 1, "<p>a</p>"), epub.Section("Two", 2, "<p>b</p>")])


def test_books_are_reproducible_and_sound():
    assert book() == book()
    assert epub.problems(book(), 2) == []
    assert epub.problems(book(), 3) == ["2 sections, not 3"]


def test_reading_back():
    p = epub.Package(book())
    assert p.contents() == [("One", "ch001.xhtml"), ("Two", "ch002.xhtml")]
    assert p.spine() == ["titlepage.xhtml", "ch001.xhtml", "ch002.xhtml"]
    assert p.metadata() == {"title": "T", "identifier": "urn:x", "language": "en"}
    assert [[(i.kind, i.text) for i in markup.items(t)] for _, _, t in p.documents()[1:]] == [[("h1", "One"), ("p", "a")], [("h1", "Two"), ("p", "b")]]


def repacked(drop: str = "", change: dict | None = None) -> bytes:
    import io
    import zipfile

    old, out = zipfile.ZipFile(io.BytesIO(book())), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            if n != drop:
                z.writestr(n, (change or {}).get(n, old.read(n)), zipfile.ZIP_STORED)
    return out.getvalue()


def edited(name: str, old: str, new: str) -> bytes:
    import io
    import zipfile

    text = zipfile.ZipFile(io.BytesIO(book())).read(name).decode()
    assert old in text
    return repacked(change={name: text.replace(old, new, 1)})


@pytest.mark.parametrize(
    ("content", "says"),
    [
        (b"", "empty file"),
        (b"x", "not a zip archive"),
        (repacked("mimetype"), "mimetype isn't first"),
        (repacked("mimetype"), "no mimetype"),
        (repacked(change={"mimetype": "text/plain"}), "mimetype is wrong"),
        (repacked("META-INF/container.xml"), "no container"),
        (repacked(change={"META-INF/container.xml": "<x>"}), "container isn't well-formed"),
        (repacked(change={"META-INF/container.xml": "<x/>"}), "container names no package document"),
        (repacked("OEBPS/content.opf"), "no package document"),
        (repacked(change={"OEBPS/content.opf": "<x>"}), "package document isn't well-formed"),
        (repacked(change={"OEBPS/content.opf": "<x/>"}), "no metadata"),
        (repacked(change={"OEBPS/content.opf": "<x/>"}), "no manifest"),
        (repacked(change={"OEBPS/content.opf": "<x/>"}), "no spine"),
        (repacked(change={"OEBPS/content.opf": "<x/>"}), "spine is empty"),
        (repacked(change={"OEBPS/content.opf": "<x/>"}), "no navigation document"),
        (edited("OEBPS/content.opf", '<item id="css"', "<item"), "manifest item without id or href"),
        (edited("OEBPS/content.opf", '<item id="css"', '<item id="ncx"'), "manifest id ncx repeats"),
        (edited("OEBPS/content.opf", "dcterms:modified", "x"), "no modification date"),
        (edited("OEBPS/content.opf", 'unique-identifier="bookid"', 'unique-identifier="x"'), "unique-identifier doesn't resolve"),
        (edited("OEBPS/content.opf", '<itemref idref="ch002"/>', '<itemref idref="x"/>'), "spine names x, which isn't listed"),
        (repacked("OEBPS/text/ch002.xhtml"), "missing text/ch002.xhtml"),
        (repacked("OEBPS/nav.xhtml"), "missing nav.xhtml"),
        (edited("OEBPS/nav.xhtml", 'epub:type="toc" id', "id"), "navigation has no contents list"),
        (repacked(change={"OEBPS/nav.xhtml": '<html xmlns:e="http://www.idpf.org/2007/ops"><nav e:type="toc"/></html>'}), "empty navigation"),
        (edited("OEBPS/nav.xhtml", "text/ch002.xhtml", "x.xhtml"), "navigation to x.xhtml"),
        (repacked(change={"OEBPS/text/ch001.xhtml": "<html><p></html>"}), "OEBPS/text/ch001.xhtml isn't well-formed"),
        (repacked(change={"OEBPS/text/ch001.xhtml": "<html><img/></html>"}), "image without source in OEBPS/text/ch001.xhtml"),
        (repacked(change={"OEBPS/text/ch001.xhtml": "<html><img src='x.png'/></html>"}), "image x.png of OEBPS/text/ch001.xhtml"),
    ],
)
def test_broken_packages(content, says):
    assert says in epub.problems(content)


def test_equal_documents_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(epub.markup, "items", lambda t, items=markup.items: read.append(t) or items(t))
    df = spark.createDataFrame([(1, "")], "source_id long, html string")
    runs = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    epub.page_items(df)
    texts = ["<p>a<p>b", None, "<h1>c</h1>", "<p>" + "d" * 5000]
    rows = [(k, texts[k % 4]) for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), pa.array([t for _, t in rows])], ["source_id", "html"])
    got = [tuple(r.values()) for b in runs[0](iter([batch, batch])) for r in b.to_pylist()]
    assert len(read) == 5  # the long one again for the second batch
    assert got == 2 * [(s, 0, k, i.kind, i.text, i.quoted) for s, t in rows for k, i in enumerate(markup.items(t or ""))]


def test_large_equal_documents_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(epub, "BATCH_BYTES", 1000)
    df = spark.createDataFrame([(k, f"<p>{'x' * (k % 3) * 200}</p><p>y</p>") for k in range(50)], "source_id long, html string")
    got = {(r.source_id, r.ord): r.text for r in epub.page_items(df).collect()}
    assert got == {(k, o): t for k in range(50) for o, t in enumerate([t for t in ("x" * (k % 3) * 200, "y") if t])}
