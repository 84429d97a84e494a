import json

import pytest
from pyspark.sql import functions as F

from foliate.functions.text import link_type
from foliate.operators import elements as el
from foliate.operators import graph
from foliate.operators.markdown import Inline, blocks, document_blocks, whole_lines
from foliate.plans.chunker import Chunker
from foliate.sources.documents import as_json, write_json
from foliate.streaming.chunks import chunk_stream, read_documents, write_chunks


def shape(text):
    return [(b["kind"], b["level"], b["content"]) for b in document_blocks(text)]


@pytest.mark.parametrize("text,want", [
    ("# A #\n\nText *em* **strong** `code`\nmore\n", [("heading", 1, "A"), ("paragraph", 0, "Text em strong code more")]),
    ("Title\n===\nSub\n---\n", [("heading", 1, "Title"), ("heading", 2, "Sub")]),
    ("- a\n- b\n  - c\n\n- d", [("list", 0, "• a\n• b\n• d")]),
    ("1. a\n2. b\n\ntext", [("list", 0, "• a\n• b"), ("paragraph", 0, "text")]),
    ("```py\n# no heading\nx\n```\nafter", [("code_block", 0, "# no heading\nx"), ("paragraph", 0, "after")]),
    ("~~~\nopen to the end", [("code_block", 0, "open to the end")]),
    ("    code\n\n    more\n\ntext", [("code_block", 0, "code\n\nmore"), ("paragraph", 0, "text")]),
    ("> quoted *x*\nlazy\n\n***\n", [("paragraph", 0, "quoted x lazy")]),
    ("a | b\n--|--\n1 | 2", [("paragraph", 0, "a"), ("paragraph", 0, "b"), ("paragraph", 0, "1"), ("paragraph", 0, "2")]),
    ("<div>\nraw\n</div>\n\nx &amp; y <b>z</b> \\*w\\*", [("paragraph", 0, "x  y z *w*")]),
    ("[r]: http://x.y 'T'\n\nsee [r] and [t][r] <http://a.b>", [("paragraph", 0, "see r and t ")]),
    ("snake_case_word and 2*3*4", [("paragraph", 0, "snake_case_word and 234")]),
    ("#no\n####### seven", [("paragraph", 0, "#no ####### seven")]),
    ("##\n", [("heading", 2, "")]), ("", []), ("\n \n", []),
])
def test_blocks(text, want):
    assert shape(text) == want


def test_places():
    text = "# A\n\npara one\nline two\n\n- x\n- y\n"
    assert [(text[b["start"] : b["stop"] + 1], b["line"]) for b in document_blocks(text)] == [("# A", 0), ("para one\nline two", 2), ("- x\n- y", 5)]


def test_inline_links():
    (b,) = document_blocks('![alt](i.png) [a *b*](<u v> "T") [in [side]](x(y).md) www.site.org/p, [no](bad url)')
    assert [(x["url"], x["text"], x["title"]) for x in b["links"]] == [("i.png", "alt", None), ("u v", "a b", "T"), ("x(y).md", "in [side]", None), ("http://www.site.org/p", "www.site.org/p", None)]


def test_link_types(spark):
    cases = {
        "http://a": "External", "https://a": "External", "mailto:x": "Email", "#a": "Anchor", "./a": "Internal", "../a": "Internal", "a.md": "Internal", "a.html": "Internal", "a/b": "Internal",
        "ftp://h/x": "Other", "": "Other", "a.md#x": "Other", "//cdn/x": "Internal", "tel:1": "Other", "HTTP://H/x": "Other",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string").select("url", "want", link_type(F.col("url")).alias("got")).collect()
    assert [(r["url"], r["got"]) for r in rows] == [(r["url"], r["want"]) for r in rows]


DOC = "lead [x](./lead.md)\n\n# A\n\npara [l](./b.md) [e](http://c)\n\n### C\n\n- item [m](m.md \"t\")\n\n## B\n\n```\ncode\n```\n\n#### D\n"


@pytest.fixture(scope="module")
def doc_graph(spark):
    df = spark.createDataFrame([("d", DOC), ("blank", " ")], "source_id string, text string")
    return Chunker.create_structure_first().process_with_structure(df)


def test_elements_and_edges(doc_graph):
    kinds = {r["element_id"]: (r["element_type"], r["level"], r["content"]) for r in doc_graph.elements.collect()}
    assert kinds["d#e1l1"] == ("link", 0, "x") and kinds["d#e3l1"] == ("link", 0, "l") and kinds["d#e5l1"][2] == "m" and "d#e3l2" not in kinds
    ties = [(r["source_element_id"], r["target_element_id"], r["relationship_type"]) for r in doc_graph.edges.orderBy("edge_ord").collect()]
    assert ties == [
        ("d#e1", "d#e1l1", "LINKS_TO"), ("d#e2", "d#e3", "CONTAINS"), ("d#e3", "d#e3l1", "LINKS_TO"), ("d#e2", "d#e4", "HAS_NESTED_SECTION"), ("d#e4", "d#e5", "CONTAINS"), ("d#e5", "d#e5l1", "LINKS_TO"),
        ("d#e2", "d#e6", "HAS_SUBSECTION"), ("d#e6", "d#e7", "CONTAINS"), ("d#e6", "d#e8", "HAS_NESTED_SECTION"),
    ]
    assert {r["element_id"] for r in doc_graph.root_elements().collect()} == {"d#e1", "d#e1l1", "d#e2", "d#e3l1", "d#e4", "d#e5l1", "d#e8"}
    assert {r["element_id"] for r in doc_graph.child_elements("d#e2").collect()} == {"d#e3", "d#e6"}
    assert ("d#e5", "d#e4") in {(r["element_id"], r["parent_element_id"]) for r in doc_graph.parent_elements().collect()}
    assert doc_graph.has_structure and graph.histogram(doc_graph.edges, "relationship_type").count() == 4
    meta = {r["element_id"]: r["metadata"] for r in doc_graph.elements.collect()}
    assert meta["d#e5"]["HasChildren"] == "true" and meta["d#e3"]["LinkCount"] == "2" and meta["d#e5l1"]["LinkTitle"] == "t"


def test_chunks(doc_graph):
    rows = doc_graph.chunks.orderBy("seq").collect()
    assert [r["clean_title"] for r in rows] == ["Paragraph 1", "A", "Paragraph 3", "C", "List 5", "B", "Code Block 7", "D"]
    assert all(r["parent_id"] is None for r in rows) and rows[1]["raw_title"] == "# A" and rows[6]["original_markdown"] == "```\ncode\n```"


def test_fallback_to_chunks(spark):
    df = spark.createDataFrame([("d", "# A\nx")], "source_id string, text string")
    assert not Chunker().process_with_structure(df).has_structure


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("d", "# A\nx")], "source_id string, text string")
    chunks = Chunker().process(df).chunks
    got = json.loads(as_json(chunks).first()["json"])
    assert got["clean_title"] == "A" and got["keywords"] == [] and "parent_id" not in got
    write_json(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batch = lambda i: spark.createDataFrame([(f"d{i}", "# A\nx\n## B\ny")], "source_id string, text string").write.mode("append").parquet(src)
    for i in range(2):
        batch(i)
        write_chunks(chunk_stream(read_documents(spark, src)), out, state).awaitTermination(60)
    rows = spark.read.parquet(out).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["parent_id"]) for r in rows] == [("d0#1", None), ("d0#2", "d0#1"), ("d1#1", None), ("d1#2", "d1#1")]


@pytest.mark.parametrize("text,want", [
    ("$$\na + b\n$$\n\ncost is $x_1$ or $5 and $6", [("code_block", 0, "a + b"), ("paragraph", 0, "cost is  or $5 and $6")]),
    ("# T {#id .big}\n\nsee{.x} {no} end {a=b}", [("heading", 1, "T"), ("paragraph", 0, "see {no} end")]),
    ("a[^1] b[^2] c[^9]\n\n[^2]: two\n[^1]: one\n    more\n\n    next\n\nz\n\n[^3]: never", [("paragraph", 0, "a b c[^9]"), ("paragraph", 0, "z"), ("paragraph", 0, "one more"), ("paragraph", 0, "next"), ("paragraph", 0, "two")]),
    ("Term\n:   meaning one\n:   meaning two\n\nplain", [("paragraph", 0, "meaning one"), ("paragraph", 0, "meaning two"), ("paragraph", 0, "plain")]),
    ("H~2~O x^2^ ++in++ ==mark== ~~out~~ a + b == c ~5 and ~6", [("paragraph", 0, "H2O x2 in mark out a + b == c ~5 and ~6")]),
])
def test_extensions(text, want):
    assert shape(text) == want


def test_whole_lines():
    rows = [("a\nbcd ef\ng", 4, 5), ("a\nbcd", 2, 2), ("ab\n", 0, 1), ("abc", 1, 9)]
    assert [whole_lines(*r) for r in rows] == ["bcd ef", "", "ab", ""]


def test_graph_from_one_parse(spark):
    """What the graph says from its parsed documents is what joins of its tables say."""
    texts = ["# A\n\ntext [x](./x.md) and [y](../y.md)\n\n### B\n\nmore\n\n## C\n\n- i\n", "plain\n\n# D\n", "", "## E\n\n# F\n\n```\nc\n```\n"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_id string, text string")
    made = Chunker.create_structure_first().process_with_structure(docs)
    rows = lambda df: sorted((r["source_id"], r["element_id"], r["element_type"]) for r in df.collect())
    assert rows(made.root_elements()) == rows(graph.root_elements(made.elements, made.edges))
    assert sorted(map(tuple, made.parent_elements().collect())) == sorted(map(tuple, graph.parent_elements(made.elements, made.edges).collect()))
    assert rows(made.child_elements("d0#e1")) == rows(graph.child_elements(made.elements, made.edges, "d0#e1")) != []
    assert made.edges.where("created_at is null").count() == 0


def test_plain_runs_take_one_step():
    """Plain text is taken in runs, not by the character; marks, line breaks and addresses within it are still seen."""
    import sys

    inline, calls = Inline({}), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    text = "plain words, " * 4_000
    sys.setprofile(count)
    try:
        found = inline.parse(text)
    finally:
        sys.setprofile(None)
    assert found == (text, []) and calls < 1_000
    said, links = inline.parse("a  \nb ![i](u) c++d++ xhttp://n.o www.a.b! {.k}")
    assert said == "a b i cd xhttp://n.o www.a.b!" and [x["url"] for x in links] == ["u", "http://www.a.b"]


def test_structure_of_documents_by_one_parse(spark):
    docs = spark.createDataFrame([("a", "# t"), ("b", " "), ("c", None), ("d", "> only quoted"), ("e", ""), ("e", "text")], "source_id string, text string")
    found = el.has_structure(blocks(docs))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == [("a", True), ("b", False), ("c", False), ("d", False), ("e", True), ("e", True)]
