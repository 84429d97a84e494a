"""Headings, sections, parents, paths, offsets and sizes: worked examples, and a sequential model on random documents."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.functions.rules import DEFAULT_RULES, Rule
from foliate.operators import graph, keywords, sizing, structure
from foliate.plans.chunker import Chunker
from foliate.plans.config import ChunkerConfig
from foliate.sources.documents import checked, from_files, from_table


def chunks_of(spark, text, config=None, rules=DEFAULT_RULES):
    df = spark.createDataFrame([("d", text)], "source_id string, text string")
    return [r.asDict() for r in Chunker(config, rules).process(df).chunks.orderBy("seq", "part").collect()]


def parents(rows):
    return [r["parent_seq"] for r in rows]


CASES = [
    ("# A\nx\n## B\ny\n### C\nz", ["MarkdownH1", "MarkdownH2", "MarkdownH3"], [1, 2, 3], [None, 1, 2]),
    ("1. One\n1.1 Sub\n1.2 Sub\n2. Two", ["Numeric"] * 4, [1, 2, 2, 1], [None, 1, 1, None]),
    ("# T\n1. One\n1.1 Two\n§ 42 Law\nAppendix A: More", ["MarkdownH1", "Numeric", "Numeric", "Legal", "Appendix"], [1, 1, 2, 1, 1], [None, None, 2, None, None]),
    ("plain\ntext\nonly", [], [], []),
    ("# A\n## B\n### C\n## D\n# E", ["MarkdownH1", "MarkdownH2", "MarkdownH3", "MarkdownH2", "MarkdownH1"], [1, 2, 3, 2, 1], [None, 1, 2, 1, None]),
    ("1. a\n1.1 b\n1.1.1 c\n1.1.2 d\n1.2 e\n2. f\n2.1 g", ["Numeric"] * 7, [1, 2, 3, 3, 2, 1, 2], [None, 1, 2, 2, 1, None, 6]),
    ("# A\n## 1. b\n1.1 c\n§ 3 d\n## 2. e\n2.1 f\nAppendix A: g\nA. h\nB. i", None, None, [None, 1, 1, None, 4, 4, None, None, None]),
    ("# A\n### B\n## C", None, [1, 3, 2], [None, 1, 1]),
    ("\n".join("#" * k + f" h{k}" for k in range(1, 7)), None, [1, 2, 3, 4, 5, 6], [None, 1, 2, 3, 4, 5]),
    ("   # indented\n#no space\n#\tTab", ["MarkdownH1"], [1], [None]),
    ("IV. Roman\nX. Ten\nC. Letter\nAppendix B - Dash", ["Roman", "Roman", "Letter", "Appendix"], [1] * 4, [None] * 4),
]


@pytest.mark.parametrize("text,types,levels,ups", CASES)
def test_examples(spark, text, types, levels, ups):
    rows = chunks_of(spark, text)
    assert types is None or [r["chunk_type"] for r in rows] == types
    assert levels is None or [r["level"] for r in rows] == levels
    assert parents(rows) == ups


def test_paths_skip_levels(spark):
    rows = chunks_of(spark, "# H1\n### H3\n### H3b\n1. num\n## H2")
    assert [r["heading_hierarchy"] for r in rows] == [["H1"], ["H1", "H3"], ["H1", "H3", "H3b"], ["H1", "H3", "H3b"], ["H1", "H2"]]
    assert [r["parent_heading"] for r in rows] == ["", "H1", "H1", "", "num"]


def test_offsets_and_markdown(spark):
    text = "lead\r\n# T é😀\r\n\r\nx  \r\n## U\ny\rz\n## V"
    rows = chunks_of(spark, text, ChunkerConfig(preserve_original_markdown=True))
    assert [text[r["start_offset"] :][:4] for r in rows] == ["# T ", "## U", "## V"]
    assert [r["content"] for r in rows] == ["x", "y\nz", ""]
    assert [r["end_offset"] for r in rows] == [rows[1]["start_offset"] - 1, rows[2]["start_offset"] - 1, rows[2]["start_offset"]]
    assert rows[2]["original_markdown"] == "## V" and rows[1]["original_markdown"] == "## U\ny\rz"
    assert all(r["chunk_type_enum"] == "Header" and r["is_heading"] for r in rows)


def test_custom_rules(spark):
    rules = [Rule(type="Note", pattern="^NOTE:", priority=3), Rule(type="Section", pattern=r"^SECTION (\d+): (.*)", level=1, priority=1), Rule(type="Any", pattern="^SECTION.*", level=4, priority=2)]
    rows = chunks_of(spark, "SECTION 1: One\na\nNOTE: b\nSECTION x", rules=rules)
    assert [(r["chunk_type"], r["level"], r["clean_title"]) for r in rows] == [("Section", 1, "One"), ("Note", 1, "NOTE:"), ("Any", 4, "SECTION x")]
    for bad in (dict(type="x", pattern=""), dict(type="x", pattern="y", level=0)):
        with pytest.raises(ValueError):
            Rule(**bad)
    with pytest.raises(ValueError):
        Chunker(rules=[])


def test_split_names_and_dangling_parents(spark):
    body = " ".join(f"Sentence number {i} is here." for i in range(20))
    rows = chunks_of(spark, f"# T\n{body}\n## U\nshort", ChunkerConfig(max_chunk_size=100, chunk_overlap=0, min_chunk_size=10))
    parts = [r for r in rows if r["seq"] == 1]
    assert len(parts) > 3 and parts[0]["clean_title"] == "T" and parts[1]["clean_title"] == "T (Part 2)" and all(len(r["content"]) <= 100 for r in parts)
    assert rows[-1]["parent_id"] == "d#1" and "d#1" not in {r["chunk_id"] for r in rows} and parts[0]["chunk_id"] == "d#1#1"


def test_overlap_uses_what_was_before(spark):
    rows = chunks_of(spark, "# A\n" + "a" * 30 + "\n# B\n" + "b" * 5 + "\n# C\nc", ChunkerConfig(max_chunk_size=100, chunk_overlap=10, min_chunk_size=1))
    assert [r["content"] for r in rows] == ["a" * 30, "a" * 10 + "\n\n" + "b" * 5, "c"]


def test_guards_and_sources(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# T\nx"), ("", "# T"), ("c", " \n "), (None, "# T"), ("e", None)], "source_id string, text string")
    assert checked(docs).count() == 1 and Chunker().process(docs).chunks.count() == 1
    with pytest.raises(Exception, match="blank"):
        Chunker().process(docs, strict=True).chunks.collect()
    (tmp_path / "my doc.md").write_text("# One\ntext")
    got = from_files(spark, f"{tmp_path}/*.md").collect()
    assert [(r["source_id"], r["text"]) for r in got] == [("my doc", "# One\ntext")]
    assert len(from_table(docs, None).first()["source_id"]) == 64
    assert Chunker().chunk(spark.createDataFrame([("# T",)], "text string")).count() == 1


def test_no_exchange(spark):
    df = spark.createDataFrame([("d", "# T\nx")], "source_id string, text string")
    plan = Chunker(ChunkerConfig()).process(df).chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_navigation(spark):
    df = spark.createDataFrame([("d", "# A\n## B\n### C\n## D\n# E")], "source_id string, text string")
    chunks = Chunker().process(df).chunks
    closed = graph.closure(chunks)
    up = {(r["chunk_id"], r["ancestor_id"], r["depth"]) for r in closed.collect()}
    assert up == {("d#2", "d#1", 1), ("d#3", "d#2", 1), ("d#3", "d#1", 2), ("d#4", "d#1", 1)}
    arrays = df.select("source_id", structure.section_array(F.col("text")).alias("sections"))
    assert {(r["chunk_id"], r["ancestor_id"], r["depth"]) for r in graph.closure_by_stack(arrays).collect()} == up
    assert graph.find_child(chunks, "d#1", "d#2").count() == 1 and graph.find_child(chunks, "d#1", "d#3").count() == 0
    assert graph.find_descendant(closed, "d#1", "d#3").count() == 1
    kids = {r["chunk_id"]: r["child_ids"] for r in structure.children(chunks).collect()}
    assert kids == {"d#1": ["d#2", "d#4"], "d#2": ["d#3"], "d#3": [], "d#4": [], "d#5": []}


# A sequential model


def model(text):
    kinds = [(r.type, re.compile(r.pattern, re.S), r.level) for r in sorted(DEFAULT_RULES, key=lambda r: r.priority)]
    out, stack, path, at, body = [], [], [], 0, []
    if not text.strip():
        return []

    def close(end):
        content = "\n".join(body).strip()
        if out:
            out[-1]["content"] = content
            out[-1]["end_offset"] = end if content else out[-1]["start_offset"]

    for line in re.split(r"[\r\n]", text):
        match = next(((k, m, lv) for k, p, lv in kinds if line.strip() and (m := p.match(line))), None)
        if match:
            kind, m, level = match
            close(at - 1)
            body = []
            if level is None:
                level = m[1].rstrip(".").count(".") + 1 if kind == "Numeric" else 1
            title = m[m.re.groups].strip()
            if "H" in kind and title:
                while len(path) >= level:
                    path.pop()
                path.append(title)
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append({"seq": len(out) + 1, "chunk_type": kind, "level": level, "clean_title": title, "raw_title": m[0].strip(), "start_offset": at, "heading_hierarchy": list(path), "parent_seq": stack[-1][1] if stack else None})
            stack.append((level, len(out)))
        else:
            body.append(line)
        at += len(line) + 1
    close(len(text))
    return out


_LINES = st.sampled_from(["# a", "## b ", "### c", "#### d", "###### f", "#", "# ", "1. one", "1.2 two", "1.2.3. three", "§ 4 law", "Appendix Q: x", "IX. nine", "Z. zed", "text", "", "  ", "more text here. And more!", "42 people"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(_LINES, st.sampled_from(["\n", "\r\n", "\r"])), max_size=25), min_size=20, max_size=20))
def test_sequential_model(spark, documents):
    texts = ["".join(a + b for a, b in doc) for doc in documents]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("source_id", F.col("i").cast("string"))
    got = {}
    for r in structure.sections(df).orderBy("seq").collect():
        got.setdefault(int(r["source_id"]), []).append(r)
    for i, text in enumerate(texts):
        want = model(text)
        assert [{k: r[k] for k in w} for r, w in zip(got.get(i, []), want)] == want and len(got.get(i, [])) == len(want)


def packed(pieces, limit, full, add):
    parts, cur = [], ""
    for p in pieces:
        if full(cur, p) > limit and cur:
            parts.append(cur.strip())
            cur = ""
        cur = add(cur, p)
    return parts + [cur.strip()] * bool(cur)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\té", max_size=120), min_size=20, max_size=20), st.integers(5, 40))
def test_packing_model(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.orderBy("i").select(sizing.sentences(F.col("t")), sizing.pack_sentences(F.col("t"), limit), sizing.pack_words(F.col("t"), limit)).collect()
    for text, (found, by_sentence, by_word) in zip(texts, got):
        cut, cur = [], ""
        for i, c in enumerate(text):
            cur += c
            if c in ".!?" and (i == len(text) - 1 or text[i + 1].isspace()):
                cut.append(cur)
                cur = ""
        cut = [s for s in cut + [cur] * bool(cur) if s.strip()]
        assert found == cut
        assert by_sentence == packed(cut, limit, lambda c, s: len(c) + len(s), lambda c, s: c + s + " " * (not s.endswith(" ")))
        assert by_word == packed(re.findall(r"[^ \t\n\r]+", text), limit, lambda c, w: len(c) + len(w) + 1, lambda c, w: f"{c} {w}" if c else w)


def test_own_strategy(spark):
    df = spark.createDataFrame([("d", "alpha beta")], "source_id string, text string")
    whole = lambda docs: docs.select("source_id", F.col("source_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("clean_title"), F.col("text").alias("content"))
    rows = Chunker(strategy=whole).process(df).chunks.collect()
    assert [(r["chunk_id"], r["keywords"]) for r in rows] == [("d", ["alpha", "beta"])]
    with pytest.raises(ValueError):
        structure.with_updates(df, missing=F.lit(1))


CONTRACT = """# Supply Agreement

Between two firms.

## § 1 Scope

The scope.

### 1.1 Goods

Goods are listed.

## § 2 Terms

1. Payment is due.
1.1 In thirty days.

§ 3 Liability

None beyond the law.

Appendix A: Prices
Appendix B - Places

A. First place
B. Second place
"""


def test_contract_document(spark):
    """Headings win over other patterns on the same line; outline patterns hang under what stands above them."""
    rows = chunks_of(spark, CONTRACT)
    assert [(r["chunk_type"], r["level"], r["parent_seq"]) for r in rows] == [
        ("MarkdownH1", 1, None), ("MarkdownH2", 2, 1), ("MarkdownH3", 3, 2), ("MarkdownH2", 2, 1), ("Numeric", 1, None), ("Numeric", 2, 5), ("Legal", 1, None), ("Appendix", 1, None),
        ("Appendix", 1, None), ("Letter", 1, None), ("Letter", 1, None),
    ]
    assert rows[6]["heading_hierarchy"] == ["Supply Agreement", "§ 2 Terms"] and rows[0]["metadata"] == {}


def test_fences_are_no_shelter(spark):
    rows = chunks_of(spark, "# A\n```python\n# comment\nx = 1\n```\n42 people came")
    assert [r["clean_title"] for r in rows] == ["A", "comment", "people came"] and rows[2]["chunk_type"] == "Numeric"


def test_long_documents_take_linear_time(spark):
    """A hundred thousand headings, lines, sentences or words of one document, each within the time of a few seconds."""
    import time

    n = 100_000
    texts = {"headings": "\n".join(f"# t{i}" for i in range(n)), "lines": "\n".join(f"l{i}" for i in range(n)), "words": "# t\n" + " ".join(f"word{i}." for i in range(n))}
    docs = spark.createDataFrame(list(texts.items()), "source_id string, text string").cache()
    assert docs.count() == 3
    began = time.time()
    found = structure.sections(docs, preserve_markdown=True).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("start_offset").alias("at")).collect()
    assert {r["source_id"]: r["n"] for r in found} == {"headings": n, "words": 1}
    assert structure.lines(docs).where("source_id = 'lines'").agg(F.max("start_offset")).first()[0] == len(texts["lines"]) - len(f"l{n - 1}")
    parts = docs.where("source_id = 'words'").select(F.size(sizing.pack_sentences(F.col("text"), 20)), F.size(sizing.pack_words(F.col("text"), 20))).first()
    assert min(parts) > n / 4
    words = docs.where("source_id = 'words'").select(F.size(keywords.frequencies(F.split("text", " ")))).first()[0]
    assert words == n + 1
    assert time.time() - began < 90


def test_names_keep_their_plus(spark, tmp_path):
    for name in ("a+b.md", "a b.md", "a%20c.md"):
        (tmp_path / name).write_text("x")
    assert {r["source_id"] for r in from_files(spark, str(tmp_path)).collect()} == {"a+b", "a b", "a%20c"}


def test_closure_of_deep_trees_and_cycles(spark):
    deep = spark.createDataFrame([("d", str(i), str(i - 1) if i else None) for i in range(70)], "source_id string, chunk_id string, parent_id string").coalesce(1)
    assert graph.closure(deep).agg(F.max("depth")).first()[0] == 69
    loop = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a")], "source_id string, chunk_id string, parent_id string")
    with pytest.raises(ValueError, match="own ancestor"):
        graph.closure(loop)


def test_rules_in_the_engines_dialect(spark):
    rule = Rule(type="Named", pattern=r"^(?<key>\p{Lu}+): (.*)")
    assert rule.groups == 2
    with pytest.raises(ValueError):
        Rule(type="Other", pattern=r"^(?P<key>x) (.*)")
    df = spark.createDataFrame([("d", "ABC: title\ntext")], "source_id string, text string")
    assert [r["clean_title"] for r in structure.sections(df, [rule]).collect()] == ["title"]
