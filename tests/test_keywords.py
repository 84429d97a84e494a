import pytest
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.functions.validation import keyword_error_rows, keyword_errors, mapping_errors
from foliate.operators import analytics, keywords
from foliate.plans.chunker import Chunker
from foliate.plans.config import ChunkerConfig


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_simple_keywords(spark):
    text = "Machine learning and machine Learning: the machine naïve machine_x abc1 to of we up"
    assert one(spark, keywords.simple_keywords(F.col("c")), c=text) == ["machine", "learning"]
    assert one(spark, keywords.cleaned_keywords(F.col("c")), c=text) == ["machine", "learning"]
    assert one(spark, keywords.simple_keywords(F.col("c")), c="snake_case snake") == ["snake"]
    assert one(spark, keywords.cleaned_keywords(F.col("c")), c="snake_case snake") == ["snake", "case"]
    assert one(spark, keywords.simple_keywords(F.col("c"), 3), c="eleven twelve thirteen fourteen fifteen") == ["eleven", "fifteen", "fourteen"]
    assert one(spark, keywords.simple_keywords(F.col("c")), c=" \n") == [] and len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 151


DOC = "# Intro\nalpha beta\n## API Guide\nalpha gamma\n## Install\nbeta"


def _chunks(spark, config):
    df = spark.createDataFrame([("d", DOC)], "source_id string, text string")
    return {r["clean_title"]: r["keywords"] for r in Chunker(config).process(df).chunks.collect()}


def test_merging(spark):
    got = _chunks(spark, ChunkerConfig(custom_keywords=("Beta", "x y"), section_keyword_mappings={"api|REST": ("endpoint", "BETA"), "^install$": ("setup",)}, max_keywords_per_chunk=4))
    assert got == {"Intro": ["Beta", "x y", "alpha"], "API Guide": ["Beta", "x y", "endpoint", "alpha"], "Install": ["Beta", "x y", "setup"]}
    assert set(map(tuple, _chunks(spark, ChunkerConfig(extract_keywords=False, custom_keywords=("a",))).values())) == {()}
    inherited = _chunks(spark, ChunkerConfig(inherit_parent_keywords=True))
    assert inherited["API Guide"] == ["alpha", "beta", "gamma"] and inherited["Intro"] == ["alpha", "beta"]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [("a", ["api", "REST", "http"]), ("b", ["API", "rest", "json"]), ("c", ["api", "auth", "auth"]), ("d", []), ("e", None), ("f", ["json", "api", "Rest"]), ("g", ["http", "REST", "api"])]
    return spark.createDataFrame(rows, "chunk_id string, keywords array<string>")


def test_analytics(tagged):
    pairs = {(r[0], r[1]): r[2] for r in analytics.related(tagged, 2, tagged).collect()}
    assert pairs["a", "b"] == 2 and pairs["a", "g"] == 3 and ("a", "c") not in pairs
    few = tagged.where("chunk_id in ('c', 'a')")
    assert {(r[0], r[1]): r[2] for r in analytics.related(few, 1, few).collect()} == {("a", "c"): 1, ("c", "a"): 1}
    shared = {(r[0], r[1]): r[2] for r in analytics.similar(tagged, tagged).collect()}
    assert shared["a", "b"] == 0.5 and shared["a", "c"] == 0.25 and shared["a", "g"] == 1.0
    score = analytics.similarity(F.col("x.keywords"), F.col("y.keywords"))
    both = tagged.alias("x").join(tagged.alias("y"), F.col("x.chunk_id") < F.col("y.chunk_id")).select(F.col("x.chunk_id"), F.col("y.chunk_id"), score).collect()
    assert all((r[2] or 0) == shared.get((r[0], r[1]), 0.0) for r in both)
    assert [tuple(r) for r in analytics.top_keywords(tagged, 2).collect()] == [("api", 5), ("REST", 4)]
    assert {r[0].lower() for r in analytics.all_keywords(tagged).collect()} == {"api", "rest", "http", "json", "auth"}
    rows = analytics.keyword_index(tagged)
    assert {tuple(r) for r in rows.where("keyword in ('auth', 'http')").collect()} == {("auth", "c", 2), ("http", "a", 1), ("http", "g", 1)}
    index = {r[0]: r[1] for r in analytics.listed(rows, "keyword").collect()}
    assert index["auth"] == ["c", "c"] and index["http"] == ["a", "g"]
    groups = analytics.signature_groups(tagged)
    assert {tuple(r) for r in groups.collect()} == {("api|http|REST", "a"), ("api|http|REST", "g")}
    assert [tuple(r) for r in analytics.listed(groups, "signature").collect()] == [("api|http|REST", ["a", "g"])]
    with pytest.raises(Exception, match="more chunks"):
        analytics.listed(rows, "keyword", largest=3).collect()
    hit = tagged.select("chunk_id", analytics.contains_any(F.col("keywords"), ["JSON", "no"]).alias("any"), analytics.contains_all(F.col("keywords"), ["Api", "json"]).alias("all"), analytics.contains_all(F.col("keywords"), []).alias("none"))
    got = {r["chunk_id"]: (r["any"], r["all"], r["none"]) for r in hit.collect()}
    assert got["b"] == (True, True, True) and got["a"] == (False, False, True) and got["d"] == got["e"] == (False, False, False)


BAD = ["ok", "", None, " pad", "x" * 101, "line\nbreak", "OK", "  "]
SAID = [
    "Keyword at index 1 is null or empty", "Keyword at index 2 is null or empty", "Keyword ' pad' has leading or trailing whitespace",
    f"Keyword '{'x' * 101}' exceeds maximum length of 100 characters", "Keyword 'line\nbreak' contains line breaks", "Keyword at index 7 is null or empty", "Duplicate keyword found: 'ok'",
]


def test_validation(spark):
    assert keyword_errors(BAD) == SAID and keyword_errors(["a", "b"]) == [] and keyword_errors(None) == ["Keywords collection cannot be null"]
    rows = keyword_error_rows(spark.createDataFrame([(1, BAD)], "list_id int, keywords array<string>"))
    assert [r["message"] for r in rows.orderBy(F.col("ord").asc_nulls_last()).collect()] == SAID
    errors = mapping_errors({"": ["a"], "(": ["a"], "ok": ["a", "A"], "nil": None})
    assert errors[0] == "Section mapping pattern cannot be null or empty" and errors[1].startswith("Invalid regex pattern '('")
    assert errors[2:] == ["Pattern 'ok': Duplicate keyword found: 'a'", "Pattern 'nil': Keywords collection cannot be null"]
    assert mapping_errors(None) == ["Section mappings cannot be null"]
    assert one(spark, tx.sanitized_keyword(F.col("c")), c="  Big \t Data ") == "big data" and one(spark, tx.sanitized_keyword(F.col("c")), c=" ") is None
    assert one(spark, tx.sanitized_keywords(F.col("c")), c=["A b", " a  B", "", "c"]) == ["a b", "c"]


@pytest.mark.parametrize("change", [
    dict(max_chunk_size=0), dict(min_chunk_size=0), dict(min_chunk_size=1000), dict(chunk_overlap=-1), dict(chunk_overlap=1000), dict(max_keywords_per_chunk=0), dict(custom_keywords=("a", " ")),
    dict(section_keyword_mappings={" ": ("a",)}), dict(section_keyword_mappings={"a": ("",)}), dict(section_keyword_mappings={"(": ("a",)}),
    dict(section_keyword_mappings={"(a+)+b": ("a",)}), dict(section_keyword_mappings={"(?P<n>a)": ("a",)}),
])
def test_bad_configuration(change):
    with pytest.raises(ValueError):
        Chunker(ChunkerConfig(**change))


def test_presets():
    c = ChunkerConfig
    assert (c.large_documents().max_chunk_size, c.small_documents().chunk_overlap, c.performance().min_chunk_size) == (2000, 100, 150)
    assert not c.performance().extract_keywords and c.with_custom_keywords(["k"] * 9).max_keywords_per_chunk == 14 and c.with_custom_keywords([]).max_keywords_per_chunk == 10
    mapped = c.document_mapping(["a"], {"x": ["y"]})
    assert mapped.inherit_parent_keywords and mapped.max_keywords_per_chunk == 15 and c.default() == c()
    for preset in (c.default(), c.large_documents(), c.small_documents(), c.performance(), mapped):
        assert preset.validate() is preset


def test_pairs_in_blocks_of_queries(spark):
    """The pairs of blocks of any size are those of a plain count, and nothing of them is exchanged."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    sets = {f"{i}#1": [rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(6))] for i in range(60)}
    rows = spark.createDataFrame([*sets.items(), ("none#1", None)], "chunk_id string, keywords array<string>")
    queries = rows.where("chunk_id in ('0#1', '7#1', '20#1', '33#1', '50#1', 'none#1')")
    up = {k: [w.upper() for w in v] for k, v in sets.items()}
    asked = [k for k in ("0#1", "7#1", "20#1", "33#1", "50#1")]
    shared = {(q, o): sum(w in up[q] for w in up[o]) for q in asked for o in up if q != o}
    alike = {(q, o): len(a & b) / len(a | b) for q in asked for o in up if q != o and (a := set(up[q])) & (b := set(up[o]))}
    for at_once in (1, 2, 100):
        found = analytics.related(rows, 2, queries, at_once)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r[0], r[1]): r[2] for r in found.collect()} == {k: n for k, n in shared.items() if n >= 2}
        assert {(r[0], r[1]): r[2] for r in analytics.similar(rows, queries, 0.2, at_once).collect()} == {k: x for k, x in alike.items() if x > 0.2}


def test_tokens_at_the_edges_of_words(spark):
    """Only whole runs of letters count; a neighbour from another script, a mark, digit or connector is part of the word."""
    text = "Straße éclair cafe\u0301 plain \u212Aelvin x_y abc1 THE api-Docs fooİ foo\u200dbar ab API naïve-word"
    df = spark.createDataFrame([(text,)], "c string").select(tx.keyword_tokens(F.col("c")))
    assert df.first()[0] == ["plain", "api", "docs", "foo", "bar", "api", "word"]


def test_repeats_are_dealt_out_before_they_are_counted(spark):
    rows = keyword_error_rows(spark.createDataFrame([(1, BAD)], "list_id int, keywords array<string>"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "HashAggregate" not in plan.split("Exchange")[-1]
