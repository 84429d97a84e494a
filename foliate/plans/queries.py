"""Queries over the driver's tables, and SQL of another shape for each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.functions.rules import Rule, chunk_kind
from foliate.functions.validation import keyword_error_rows
from foliate.operators import analytics, graph, keywords, markdown, sizing, structure, vectors
from foliate.operators import elements as el
from foliate.plans import oracles as o
from foliate.plans.chunker import Chunker
from foliate.plans.config import ChunkerConfig
from foliate.sources.documents import as_json, overlaid, overlaid_markdown, spread
from foliate.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaid(spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def _sections(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return structure.sections(_docs(spark, sf_dir), **options)


def _section_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source_id", structure.section_array(F.col("text")).alias("sections"))


def _chunk_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Chunker().process(_docs(spark, sf_dir)).chunks.select("chunk_id", "keywords")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(overlaid_markdown(spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")))


_ID = "source_id || '#' || seq"

# Lines and rules


@query(o.BASE + "select cast(doc_id as varchar) as source_id, pos, line from overlay")
def lines_split(s, d):
    return structure.lines(_docs(s, d)).select("source_id", "pos", "line")


@query(o.BASE + "select cast(doc_id as varchar) as source_id, pos, cast(start_offset as bigint) as start_offset from placed")
def line_offsets(s, d):
    return structure.lines(_docs(s, d)).select("source_id", "pos", "start_offset")


@query(o.BASE + "select source_id, pos, type, cast(level as bigint) as level from heads")
def line_classify(s, d):
    return structure.classified(_docs(s, d)).select("source_id", "pos", "type", F.col("level").cast("bigint").alias("level"))


@query(o.BASE + "select cast(doc_id as varchar) as source_id, pos, case when regexp_matches(line, '^#+\\s') then 'Any' else 'Marked' end as type from overlay where regexp_matches(line, '^[#§]+\\s')")
def rule_priority(s, d):
    rules = [Rule(type="Marked", pattern=r"^[#§]+\s+(.*)", priority=9), Rule(type="Any", pattern=r"^#+\s+(.*)", priority=2)]
    return structure.classified(_docs(s, d), rules).select("source_id", "pos", "type")


@query(o.BASE + "select source_id, pos, cast(level as bigint) as level from heads where type = 'Numeric'")
def dynamic_level(s, d):
    return structure.classified(_docs(s, d)).where("type = 'Numeric'").select("source_id", "pos", F.col("level").cast("bigint").alias("level"))


@query(o.BASE + "select source_id, pos, raw_title, clean_title from heads")
def title_extract(s, d):
    return structure.classified(_docs(s, d)).select("source_id", "pos", "raw_title", "clean_title")


@query(o.BASE + """select source_id, seq, case when regexp_matches(line, '^[A-Z][a-z]*ed ') then 'Ended' else 'Capital' end as type from (
  select cast(doc_id as varchar) as source_id, line, row_number() over (partition by doc_id order by pos) as seq from split where regexp_matches(line, '^[A-Z][a-z]* '))""")
def custom_rules(s, d):
    rules = [Rule(type="Capital", pattern="^[A-Z][a-z]* (.*)", level=2, priority=5), Rule(type="Ended", pattern="^([A-Z][a-z]*ed) (.*)", level=1, priority=1)]
    rows = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text")
    return structure.sections(rows, rules).select("source_id", "seq", F.col("chunk_type").alias("type"))


@query(o.BASE + "select source_id, seq, 'Header' as kind, true as heading from heads")
def chunk_kinds(s, d):
    return _sections(s, d).select("source_id", "seq", F.col("chunk_type_enum").alias("kind"), F.col("is_heading").alias("heading"))


@query(o.BASE + """select source_id, pos, case when type like '%Numeric%' then 'Numeric' when type like '%Legal%' then 'Legal' when type like '%Appendix%' then 'Appendix' when type like 'Markdown%' then 'Header' else 'Content' end as kind from heads""")
def chunk_kind_by_type(s, d):
    return structure.classified(_docs(s, d)).select("source_id", "pos", chunk_kind(F.col("type"), F.lit("")).alias("kind"))


# Sections


@query(o.BASE + "select source_id, seq, chunk_type, cast(level as bigint) as level, raw_title, clean_title, content, cast(start_offset as bigint) as start_offset, cast(end_offset as bigint) as end_offset, cast(parent_seq as bigint) as parent_seq from sections")
def sections(s, d):
    return _sections(s, d).select("source_id", "seq", "chunk_type", F.col("level").cast("bigint").alias("level"), "raw_title", "clean_title", "content", "start_offset", "end_offset", "parent_seq")


@query(o.BASE + "select source_id, seq, content, cast(length(content) as bigint) as content_length from sections")
def section_content(s, d):
    return _sections(s, d).select("source_id", "seq", "content", F.length("content").cast("bigint").alias("content_length"))


@query(o.BASE + "select source_id, seq, cast(start_offset as bigint) as start_offset, cast(end_offset as bigint) as end_offset, cast(end_offset - start_offset as bigint) as total_length from sections")
def section_offsets(s, d):
    return _sections(s, d).select("source_id", "seq", "start_offset", "end_offset", (F.col("end_offset") - F.col("start_offset")).alias("total_length"))


@query(o.BASE + """, whole as (select cast(doc_id as varchar) as source_id, string_agg(line, chr(10) order by pos) as text from overlay group by doc_id)
select source_id, seq, case when content = '' then substr(text, cast(start_offset as bigint) + 1, length(raw_title)) else substr(text, cast(start_offset as bigint) + 1, cast(end_offset - start_offset as bigint)) end as original_markdown
from sections join whole using (source_id)""")
def original_markdown(s, d):
    return _sections(s, d, preserve_markdown=True).select("source_id", "seq", "original_markdown")


@query(o.BASE + f"select source_id, {_ID} as chunk_id, source_id || '#' || parent_seq as parent_id from sections")
def chunk_parent(s, d):
    return _sections(s, d).select("source_id", "chunk_id", "parent_id")


@query(o.BASE + "select c.source_id, c.seq, coalesce(p.clean_title, '') as parent_heading from sections c left join sections p on p.source_id = c.source_id and p.seq = c.parent_seq")
def parent_heading(s, d):
    return _sections(s, d).select("source_id", "seq", "parent_heading")


@query(o.BASE + f"""select source_id, {_ID} as chunk_id, (select count(*) from sections k where k.source_id = c.source_id and k.parent_seq = c.seq) as n_children,
coalesce((select string_agg(k.source_id || '#' || k.seq, ',' order by k.seq) from sections k where k.source_id = c.source_id and k.parent_seq = c.seq), '') as child_ids from sections c""")
def children_count(s, d):
    return structure.children(_sections(s, d)).withColumn("child_ids", F.array_join("child_ids", ","))


_PATH = """, eligible as (
  select source_id, seq, level, clean_title, row_number() over (partition by source_id order by seq) as k from sections where chunk_type like '%H%' and clean_title <> ''),
deep as (
  select *, k + least(0, min(level - k) over (partition by source_id order by k)) as depth from eligible),
entries as (
  select d.source_id, d.seq, e.depth, arg_max(e.clean_title, e.k) as title from deep d join deep e on e.source_id = d.source_id and e.k <= d.k and e.depth <= d.depth group by all),
paths as (select source_id, seq, string_agg(title, ' > ' order by depth) as path, count(*) as depth from entries group by all)
select s.source_id, s.seq, coalesce(p.path, '') as full_path, cast(coalesce(p.depth, 0) as bigint) as depth
from sections s left join paths p on p.source_id = s.source_id and p.seq = (select max(q.seq) from paths q where q.source_id = s.source_id and q.seq <= s.seq)"""


@query(o.BASE + _PATH)
def heading_path(s, d):
    return _sections(s, d).select("source_id", "seq", tx.full_path(F.col("heading_hierarchy")).alias("full_path"), F.size("heading_hierarchy").cast("bigint").alias("depth"))


@query(o.BASE + _PATH.replace("select s.source_id, s.seq, coalesce(p.path, '') as full_path, cast(coalesce(p.depth, 0) as bigint) as depth", "select s.source_id || '#' || s.seq as chunk_id, coalesce(p.path, '') as full_path"))
def full_path(s, d):
    return structure.derived(_sections(s, d)).select("chunk_id", "full_path")


_CLOSURE = """, up(source_id, seq, above, depth) as (
  select source_id, seq, parent_seq, 1 from sections where parent_seq is not null
  union all select u.source_id, u.seq, s.parent_seq, u.depth + 1 from up u join sections s on s.source_id = u.source_id and s.seq = u.above where s.parent_seq is not null)
"""


@query(o.BASE + "select source_id, seq, cast(length(content) as bigint) as content_length, cast(length(clean_title) + length(content) as bigint) as total_length, parent_seq is null as is_root from sections")
def chunk_derived(s, d):
    return structure.derived(_sections(s, d)).select("source_id", "seq", "content_length", "total_length", "is_root")


@query(o.BASE + "select source_id, seq, case when content = '' then '(none)' else content end as content, clean_title from sections")
def chunk_updates(s, d):
    rows = structure.with_updates(_sections(s, d), content=F.when(F.col("content") == "", "(none)"))
    return rows.select("source_id", "seq", "content", "clean_title")


@query(o.BASE + _CLOSURE + """, deepest as (select source_id, seq, max(depth) as depth from up group by all)
select s.source_id, s.seq, repeat('  ', coalesce(depth, 0)) || '[' || chunk_type || '] ' || clean_title as line from sections s left join deepest using (source_id, seq)""")
def chunk_outline(s, d):
    return structure.outline(_docs(s, d))


@query(o.BASE + _CLOSURE + f"select source_id, {_ID} as chunk_id, source_id || '#' || above as ancestor_id, cast(depth as bigint) as depth from up")
def ancestors(s, d):
    return graph.closure_by_stack(_section_arrays(s, d)).withColumn("depth", F.col("depth").cast("bigint"))


@query(o.BASE + _CLOSURE + f"select source_id, source_id || '#' || above as chunk_id, {_ID} as descendant_id, cast(depth as bigint) as depth from up")
def descendants(s, d):
    return graph.descendants(graph.closure_by_stack(_section_arrays(s, d))).withColumn("depth", F.col("depth").cast("bigint"))


@query(o.BASE + f"select source_id, {_ID} as chunk_id, clean_title from sections where parent_seq is null")
def root_chunks(s, d):
    return structure.roots(_sections(s, d)).select("source_id", "chunk_id", "clean_title")


@query("""with recursive t(id, parent, name) as (select 'r' || r_regionkey, null, r_name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, s_name from supplier),
up(id, above, depth) as (select id, parent, 1 from t where parent is not null union all select u.id, t.parent, u.depth + 1 from up u join t on t.id = u.above where t.parent is not null)
select id as chunk_id, above as ancestor_id, cast(depth as bigint) as depth from up""")
def place_closure(s, d):
    row = lambda t, i, p: _table(s, d, t).select(F.lit("geo").alias("source_id"), F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("chunk_id"), (F.concat(F.lit(p[0]), F.col(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent_id"))
    tree = row("region", ("r", "r_regionkey"), None).unionByName(row("nation", ("n", "n_nationkey"), ("r", "n_regionkey"))).unionByName(row("supplier", ("s", "s_suppkey"), ("n", "s_nationkey")))
    return graph.closure(tree).select("chunk_id", "ancestor_id", F.col("depth").cast("bigint").alias("depth"))


# Sizes

_PLAIN_SENTENCES = """with cut as (
  select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\\S')) as s from documents)
select doc_id, cast(i as bigint) as i, s[i] as sentence from cut, unnest(range(1, len(s) + 1)) as t(i)"""


@query(_PLAIN_SENTENCES)
def sentence_split(s, d):
    rows = _table(s, d, "documents").select("doc_id", F.posexplode(sizing.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), "sentence")


def _parts(s, d, pack, size):
    rows = _sections(s, d).select("source_id", "seq", F.posexplode_outer(pack(F.col("content"), size)).alias("i", "content")).where("i is not null")
    return rows.select("source_id", "seq", (F.col("i") + 1).cast("bigint").alias("part"), "content")


_UNPACK = "\nselect source_id, seq, cast(i as bigint) as part, parts[i] as content from packed, unnest(range(1, len(parts) + 1)) as t(i)"


@query(o.BASE + o.SENTENCE_PACK.replace("{max}", "500") + _UNPACK)
def pack_sentences(s, d):
    return _parts(s, d, sizing.pack_sentences, 500)


@query(o.BASE + o.WORD_PACK.replace("{max}", "300") + _UNPACK)
def pack_words(s, d):
    return _parts(s, d, sizing.pack_words, 300)


def _split(s, d, overlap=0):
    config = ChunkerConfig(max_chunk_size=500, chunk_overlap=overlap, min_chunk_size=50, extract_keywords=False)
    return Chunker(config).process(_docs(s, d)).chunks


_PARTS = o.SENTENCE_PACK.replace("{max}", "500") + """,
parts as (
  select s.source_id, s.seq, cast(i as bigint) as part, length(s.content) > 500 and len(p.parts) > 0 as cut, s.raw_title, s.clean_title, case when length(s.content) > 500 and len(p.parts) > 0 then p.parts[i] else s.content end as content
  from sections s join packed p using (source_id, seq), unnest(range(1, case when length(s.content) > 500 and len(p.parts) > 0 then len(p.parts) else 1 end + 1)) as t(i))"""


@query(o.BASE + _PARTS + """ select source_id, seq, part, source_id || '#' || seq || case when cut then '#' || part else '' end as chunk_id, raw_title || case when part > 1 then ' (Part ' || part || ')' else '' end as raw_title,
clean_title || case when part > 1 then ' (Part ' || part || ')' else '' end as clean_title from parts""")
def part_titles(s, d):
    return _split(s, d).select("source_id", "seq", "part", "chunk_id", "raw_title", "clean_title")


@query(o.BASE + _PARTS + """ select source_id, seq, part, case when length(lag(content) over w) > 100 then right(lag(content) over w, 100) || chr(10) || chr(10) || content else content end as content
from parts window w as (partition by source_id order by seq, part)""")
def chunk_overlap(s, d):
    return _split(s, d, 100).select("source_id", "seq", "part", "content")


@query(o.BASE + _PARTS + """, ids as (select distinct source_id, source_id || '#' || seq || case when cut then '#' || part else '' end as chunk_id from parts)
select p.source_id, p.seq, p.part, k.chunk_id as parent_resolved from parts p join sections s using (source_id, seq) left join ids k on k.chunk_id = s.source_id || '#' || s.parent_seq""")
def parent_resolved(s, d):
    chunks = written(_split(s, d).select("source_id", "seq", "part", "chunk_id", "parent_id"), "chunks")
    known = chunks.select("source_id", F.col("chunk_id").alias("parent_id"), F.col("chunk_id").alias("parent_resolved"))
    return chunks.join(known, ["source_id", "parent_id"], "left").select("source_id", "seq", "part", "parent_resolved")


# Keywords


@query(o.BASE + o.tokens() + " select source_id, seq, word, count(*) as n from tokens group by all")
def kw_tokens(s, d):
    rows = structure.each(_sections(s, d).select("source_id", "seq", keywords.frequencies(tx.keyword_tokens(F.col("content"))).alias("x")), "x")
    return rows.select("source_id", "seq", "x.word", "x.n")


def _ranked(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("chunk_id", F.posexplode_outer("keywords").alias("i", "keyword")).where("i is not null")
    return rows.select("chunk_id", (F.col("i") + 1).cast("bigint").alias("rank"), "keyword")


@query(o.BASE + o.tokens() + " select chunk_id, rank, keyword from keywords")
def kw_simple(s, d):
    return _ranked(_chunk_keywords(s, d))


@query(o.BASE + o.tokens("regexp_replace(content, '[#*_`\\[\\](){}]', ' ', 'g')") + " select chunk_id, rank, keyword from keywords")
def kw_cleaned(s, d):
    return _ranked(Chunker(extractor="cleaned").process(_docs(s, d)).chunks)


CUSTOM = ("Release Notes", "the", "THE", "api")
MAPPINGS = {"^the": ("starts-the", "API"), "(er|ing)": ("suffix",), "[0-9]": ("digits",)}
_MERGE = """,
given as (
  select source_id || '#' || seq as chunk_id, clean_title, ['Release Notes', 'the', 'api'] || {mapped} as own from sections),
extracted as (select chunk_id, list(keyword order by rank) as words from keywords group by chunk_id),
all_words as (select g.chunk_id, g.own || coalesce(e.words, []) as words from given g left join extracted e using (chunk_id)),
placed_words as (select chunk_id, words[i] as keyword, i from all_words, unnest(range(1, len(words) + 1)) as t(i)),
firsts as (select chunk_id, arg_min(keyword, i) as keyword, min(i) as i from placed_words group by chunk_id, upper(keyword)),
final as (select chunk_id, keyword, row_number() over (partition by chunk_id order by i) as rank from firsts)
select chunk_id, rank, keyword from final where rank <= {k}"""


@query(o.BASE + o.tokens() + _MERGE.format(mapped="[]", k=10))
def kw_custom_merge(s, d):
    return _ranked(Chunker(ChunkerConfig(max_chunk_size=10_000_000, chunk_overlap=0, custom_keywords=CUSTOM)).process(_docs(s, d)).chunks)


@query(o.BASE + o.tokens() + _MERGE.format(k=10, mapped="""case when regexp_matches(clean_title, '(?i)^the') then ['starts-the', 'API'] else [] end
    || case when regexp_matches(clean_title, '(?i)(er|ing)') then ['suffix'] else [] end || case when regexp_matches(clean_title, '[0-9]') then ['digits'] else [] end"""))
def kw_section_map(s, d):
    config = ChunkerConfig(max_chunk_size=10_000_000, chunk_overlap=0, custom_keywords=CUSTOM, section_keyword_mappings=MAPPINGS)
    return _ranked(Chunker(config).process(_docs(s, d)).chunks)


@query(o.BASE + o.tokens() + """, own as (select source_id || '#' || s.seq as chunk_id, source_id || '#' || s.parent_seq as parent_id from sections s),
both_words as (
  select o.chunk_id, p.keyword, p.rank from own o join keywords p on p.chunk_id = o.parent_id union all select chunk_id, keyword, 100 + rank from keywords),
firsts as (select chunk_id, arg_min(keyword, rank) as keyword, min(rank) as i from both_words group by chunk_id, upper(keyword)),
final as (select chunk_id, keyword, row_number() over (partition by chunk_id order by i) as rank from firsts)
select chunk_id, rank, keyword from final where rank <= 15""")
def kw_inherit(s, d):
    chunks = written(Chunker().process(_docs(s, d)).chunks.select("source_id", "chunk_id", "parent_id", "keywords"), "keywords")
    return _ranked(keywords.inherited_from_parents(chunks, 15))


@query(o.BASE + o.tokens() + " select keyword, count(*) as frequency from keywords group by keyword order by frequency desc, upper(keyword) limit 50")
def kw_top(s, d):
    return analytics.top_keywords(_chunk_keywords(s, d), 50)


@query(o.BASE + o.tokens() + " select distinct keyword from keywords")
def kw_all(s, d):
    return analytics.all_keywords(_chunk_keywords(s, d))


@query(o.BASE + o.tokens() + " select keyword, chunk_id, count(*) as times from keywords group by all")
def kw_index(s, d):
    return analytics.keyword_index(_chunk_keywords(s, d))


def _kept_and_wanted(s, d):
    """All chunks with their keywords, and of them the stated query set: chunks of documents whose number is divisible by 50."""
    rows = analytics.kept(_chunk_keywords(s, d))
    return rows, rows.where(F.split("chunk_id", "#")[0].cast("bigint") % 50 == 0)


_WANTED = ", wanted as (select * from keywords where cast(split_part(chunk_id, '#', 1) as bigint) % 50 = 0)"


@query(o.BASE + o.tokens() + _WANTED + """ select w.chunk_id, k.chunk_id as other_id, count(*) as shared from wanted w join keywords k on w.keyword = k.keyword and w.chunk_id <> k.chunk_id group by all having count(*) >= 3""")
def kw_related(s, d):
    rows, wanted = _kept_and_wanted(s, d)
    return analytics.related(rows, 3, wanted)


@query(o.BASE + o.tokens() + _WANTED + """, sizes as (select chunk_id, count(*) as n from keywords group by 1)
select chunk_id, other_id, round(both_n / (a.n + b.n - both_n), 6) as similarity
from (select w.chunk_id, k.chunk_id as other_id, count(*) as both_n from wanted w join keywords k on w.keyword = k.keyword and w.chunk_id <> k.chunk_id group by all) join sizes a using (chunk_id) join sizes b on b.chunk_id = other_id
where both_n / (a.n + b.n - both_n) > 0.2""")
def kw_jaccard(s, d):
    rows, wanted = _kept_and_wanted(s, d)
    return analytics.similar(rows, wanted, 0.2).withColumn("similarity", F.round("similarity", 6))


SEARCH = ("Tion", "ING", "ment")
_SEARCHED = o.BASE + o.tokens() + """ select source_id || '#' || seq as chunk_id, (select count(*) from keywords k where k.chunk_id = source_id || '#' || seq and k.keyword in ('tion', 'ing', 'ment')) TEST as hit from sections"""


@query(_SEARCHED.replace("TEST", "> 0"))
def kw_contains_any(s, d):
    return _chunk_keywords(s, d).select("chunk_id", analytics.contains_any(F.col("keywords"), SEARCH).alias("hit"))


@query(_SEARCHED.replace(", 'ment')", ")").replace("TEST", "= 2"))
def kw_contains_all(s, d):
    return _chunk_keywords(s, d).select("chunk_id", analytics.contains_all(F.col("keywords"), SEARCH[:2]).alias("hit"))


@query(o.BASE + o.tokens() + """, signed as (select chunk_id, string_agg(keyword, '|' order by upper(keyword)) as signature from keywords group by chunk_id having count(*) >= 2)
select signature, chunk_id from signed where signature in (select signature from signed group by signature having count(*) > 1)""")
def kw_signature_groups(s, d):
    return analytics.signature_groups(_chunk_keywords(s, d))


@query(o.BASE + o.tokens() + """select l.quality, l.toxic, keyword, count(*) as frequency from keywords k join labels l on cast(l.doc_id as varchar) = split_part(k.chunk_id, '#', 1) group by all having count(*) > 1""")
def kw_by_label(s, d):
    each = analytics.exploded(_chunk_keywords(s, d)).withColumn("doc_id", F.split("chunk_id", "#")[0].cast("bigint"))
    return each.join(_table(s, d, "labels"), "doc_id").groupBy("quality", "toxic", "keyword").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")


def _keyword_lists(s, d):
    """Lists with faults of all kinds from customers' comments and segments."""
    c = _table(s, d, "customer")
    word = F.col("c_mktsegment")
    faults = F.array(
        word, F.when(F.col("c_custkey") % 3 == 0, F.lower(word)).otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 4 == 0, "  "), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), word)).otherwise("ok"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(word, F.lit("\n"), word)).otherwise("fine"), F.when(F.col("c_custkey") % 6 == 0, F.repeat(word, 14)).otherwise("short"),
    )
    return c.select(F.col("c_custkey").alias("list_id"), faults.alias("keywords"))


_LISTS = """with lists as (
  select c_custkey as list_id, [c_mktsegment, case when c_custkey % 3 = 0 then lower(c_mktsegment) else c_name end, case when c_custkey % 4 = 0 then '  ' end, case when c_custkey % 5 = 0 then ' ' || c_mktsegment else 'ok' end,
    case when c_custkey % 7 = 0 then c_mktsegment || chr(10) || c_mktsegment else 'fine' end, case when c_custkey % 6 = 0 then repeat(c_mktsegment, 14) else 'short' end] as k from customer),
each as (select list_id, cast(i - 1 as bigint) as ord, k[i] as w from lists, unnest(range(1, 7)) as t(i))
"""


@query(_LISTS + """select list_id, ord, 'Keyword at index ' || ord || ' is null or empty' as message from each where w is null or trim(w) = ''
union all select list_id, ord, 'Keyword ''' || w || ''' exceeds maximum length of 100 characters' from each where trim(w) <> '' and length(w) > 100
union all select list_id, ord, 'Keyword ''' || w || ''' contains line breaks' from each where trim(w) <> '' and contains(w, chr(10))
union all select list_id, ord, 'Keyword ''' || w || ''' has leading or trailing whitespace' from each where trim(w) <> '' and trim(w) <> w
union all select list_id, null, 'Duplicate keyword found: ''' || lower(w) || '''' from each where w <> '' group by list_id, lower(w) having count(*) > 1""")
def kw_validate(s, d):
    return keyword_error_rows(_keyword_lists(s, d))


@query(_LISTS + """, clean as (select list_id, ord, lower(regexp_replace(trim(w), '\\s+', ' ', 'g')) as w from each where trim(coalesce(w, '')) <> ''), firsts as (select list_id, w, min(ord) as ord from clean group by all)
select list_id, string_agg(w, ',' order by ord) as keywords from firsts group by list_id""")
def kw_sanitize(s, d):
    return _keyword_lists(s, d).select("list_id", F.array_join(tx.sanitized_keywords(F.col("keywords")), ",").alias("keywords"))


# Markdown blocks


@query(o.MARKDOWN + "select source_id, cast(ord as bigint) as ord, kind, cast(level as bigint) as level, content, start, start + length(md) - 1 as stop, line from spans")
def md_blocks(s, d):
    rows = _parsed(s, d).select("source_id", F.posexplode("blocks").alias("i", "b"))
    return rows.select("source_id", (F.col("i") + 1).cast("bigint").alias("ord"), "b.kind", F.col("b.level").cast("bigint").alias("level"), "b.content", "b.start", "b.stop", "b.line")


@query(o.MARKDOWN + """select source_id, source_id || '#b' || ord as chunk_id, case kind when 'heading' then 'Markdown' when 'paragraph' then 'Paragraph' when 'list' then 'List' else 'Code' end as chunk_type,
case when kind = 'heading' then md else '' end as raw_title, case kind when 'heading' then content when 'paragraph' then 'Paragraph ' || ord when 'list' then 'List ' || ord else 'Code Block ' || ord end as clean_title, content, md as original_markdown,
cast(level as bigint) as level, kind = 'heading' as is_heading, case when kind = 'heading' then 'Header' else 'Content' end as chunk_type_enum from spans""")
def md_chunks(s, d):
    return el.block_chunks(_parsed(s, d)).select(
        "source_id", "chunk_id", "chunk_type", "raw_title", "clean_title", "content", "original_markdown", F.col("level").cast("bigint").alias("level"), "is_heading", "chunk_type_enum"
    )


@query(o.MARKDOWN + "select source_id, element_id, element_type, content, cast(level as bigint) as level, cast(start_offset as bigint) as start_offset, cast(end_offset as bigint) as end_offset, cast(start_line as bigint) as start_line, original_markdown from elements")
def md_elements(s, d):
    return el.elements(_parsed(s, d)).select("source_id", "element_id", "element_type", "content", F.col("level").cast("bigint").alias("level"), "start_offset", "end_offset", "start_line", "original_markdown")


@query(o.MARKDOWN + "select source_id, source_id || '#e' || ord as element_id, cast(n as bigint) as ord, url, text, type from links")
def md_links(s, d):
    return el.links(_parsed(s, d)).select("source_id", "element_id", "ord", "url", "text", "type")


_URLS = "concat(case page_id % 9 when 0 then url when 1 then './' || page_id || '.md' when 2 then '../x/' || page_id when 3 then '#p' || page_id when 4 then 'mailto:a@' || page_id when 5 then 'ftp://h/' || page_id when 6 then 'a.md#' || page_id when 7 then '//cdn/' || page_id else 'tel:' || page_id end)"


@query(f"""select page_id, case when url = '' then 'Other' when starts_with(url, 'http://') or starts_with(url, 'https://') then 'External' when starts_with(url, 'mailto:') then 'Email' when starts_with(url, '#') then 'Anchor'
when starts_with(url, './') or starts_with(url, '../') or (not contains(url, '://') and (url like '%.md' or url like '%.html' or contains(url, '/'))) then 'Internal' else 'Other' end as type from (select page_id, {_URLS} as url from pages)""")
def link_types(s, d):
    return _table(s, d, "pages").select("page_id", tx.link_type(F.expr(_URLS)).alias("type"))


def _edges(kind: str) -> str:
    return o.MARKDOWN + f"select source_id, source_element_id, target_element_id, relationship_type from edges where relationship_type in ({kind})"


def _edge_rows(s, d, *kinds):
    return el.edges(_parsed(s, d)).where(F.col("relationship_type").isin(*kinds)).select("source_id", "source_element_id", "target_element_id", "relationship_type")


@query(_edges("'HAS_SUBSECTION', 'HAS_NESTED_SECTION'"))
def edges_heading(s, d):
    return _edge_rows(s, d, graph.HAS_SUBSECTION, graph.HAS_NESTED_SECTION)


@query(_edges("'CONTAINS'"))
def edges_contains(s, d):
    return _edge_rows(s, d, graph.CONTAINS)


@query(_edges("'LINKS_TO'"))
def edges_links_to(s, d):
    return _edge_rows(s, d, graph.LINKS_TO)


@query(o.MARKDOWN + "select relationship_type, count(*) as n from edges group by 1")
def edge_histogram(s, d):
    return graph.histogram(el.edges(_parsed(s, d)), "relationship_type")


@query(o.MARKDOWN + "select cast(d.doc_id as varchar) as source_id, exists (select 1 from elements e where e.source_id = cast(d.doc_id as varchar)) as has_structure from documents d")
def structure_present(s, d):
    return el.has_structure(_parsed(s, d))


@query(o.MARKDOWN + "select element_type, count(*) as n from elements group by 1")
def element_histogram(s, d):
    return graph.histogram(el.elements(_parsed(s, d)), "element_type")


_TREE = "relationship_type in ('HAS_SUBSECTION', 'CONTAINS')"


@query(o.MARKDOWN + f"select source_id, element_id, element_type from elements where element_id not in (select target_element_id from edges where {_TREE})")
def element_roots(s, d):
    return el.root_elements(_parsed(s, d)).select("source_id", "element_id", "element_type")


@query(o.MARKDOWN + f"select e.source_id, e.element_id, e.element_type from elements e join edges x on x.target_element_id = e.element_id where {_TREE} and x.source_element_id like '%#e2'")
def element_children(s, d):
    return el.child_elements(_parsed(s, d), F.col("parent_element_id").endswith("#e2")).select("source_id", "element_id", "element_type")


@query(o.MARKDOWN + f"select source_id, target_element_id as element_id, source_element_id as parent_element_id from edges where {_TREE}")
def element_parent(s, d):
    return el.parent_elements(_parsed(s, d))


# Vectors


@query(o.BASE + _CLOSURE + """, titles as (select u.source_id, u.seq, string_agg(s.clean_title, ': ' order by u.depth desc) as t from up u join sections s on s.source_id = u.source_id and s.seq = u.above where trim(s.clean_title) <> '' group by all)
select s.source_id, s.seq, case when t is null then content else t || ': ' || content end as enriched from sections s left join titles using (source_id, seq)""")
def ctx_enrich(s, d):
    return _sections(s, d).select("source_id", "seq", tx.with_context(F.col("content"), F.col("ancestor_titles")).alias("enriched"))


@query("select item_id, case when item_id % 2 = 0 then 'query: ' else 'passage: ' end || text as prefixed from benchmark")
def e5_prefix(s, d):
    return _table(s, d, "benchmark").select("item_id", tx.e5_prefixed(F.col("text"), F.col("item_id") % 2 == 0).alias("prefixed"))


@query("""with w as (select item_id, list_filter(string_split(regexp_replace(lower(text), '[\\n\\r\\t]', ' ', 'g'), ' '), lambda x: x <> '') as words from benchmark),
p as (select item_id, flatten(list_transform(words, lambda x: case when length(x) <= 6 then [x] else list_transform(range(0, length(x), 3), lambda i: substr(x, i + 1, 4)) end)) as parts from w)
select item_id, array_to_string(parts[1:510], ' ') as subwords, cast(least(len(parts), 510) + case when len(parts) < 510 then 2 else 1 end as bigint) as used from p""")
def fallback_tokens(s, d):
    rows = _table(s, d, "benchmark").select("item_id", tx.subwords(F.col("text")).alias("p"), tx.subword_ids(F.col("text")).alias("t"))
    return rows.select("item_id", F.array_join("p", " ").alias("subwords"), F.aggregate("t.attention_mask", F.lit(0), lambda a, m: a + m).cast("bigint").alias("used"))


@query("""with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as l from embeddings)
select vec_id, round(l, 5) as norm, round(case when l > 0 then embedding[1] / l else 0 end, 5) as first from n""")
def vec_l2(s, d):
    rows = _table(s, d, "embeddings").select("vec_id", vectors.l2_norm(F.col("embedding")).alias("n"), vectors.l2_normalized(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round("n", 5).alias("norm"), F.round(F.col("v")[0], 5).alias("first"))


_POOL = """with e as (select label, {mask} as m, unnest(range(64)) as i, unnest(embedding) as x from embeddings),
s as (select label, i, case when sum(m) > 0 then sum(cast(x as double) * m) / sum(m) else 0 end as v from e group by all), n as (select label, sqrt(sum(v * v)) as l from s group by label)
select cast(label as bigint) as label, i, round(v / l, 5) as x from s join n using (label)"""


def _pool(s, d, mask=None):
    rows = _table(s, d, "embeddings").withColumn("mask", (F.col("vec_id") % 4 != 0).cast("int"))
    out = vectors.mean_pooled(rows, "label", "embedding", mask).select(F.col("label").cast("bigint").alias("label"), F.posexplode("vector").alias("i", "x"))
    return out.select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 5).alias("x"))


@query(_POOL.format(mask="1"))
def pool_mean(s, d):
    return _pool(s, d)


@query(_POOL.format(mask="case when vec_id % 4 <> 0 then 1 else 0 end"))
def pool_masked(s, d):
    return _pool(s, d, "mask")


@query("""with t as (select item_id, case when item_id % 5 = 0 then '  ' else text end as text from benchmark)
select item_id, cast(1024 as bigint) as n, cast(case when trim(text) = '' then 0 else 1 end as double) as norm, count(*) over (partition by text) as same from t""")
def vec_hash(s, d):
    """Size, length and equality of vectors; blank texts give zeros, equal texts equal vectors, others others."""
    blank = F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.col("text"))
    rows = _table(s, d, "benchmark").select("item_id", vectors.hash_vector(blank).alias("v"))
    rows = rows.select("item_id", F.size("v").cast("bigint").alias("n"), F.round(vectors.l2_norm(F.col("v")), 6).alias("norm"), F.sha2(F.to_json("v"), 256).alias("key"))
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("same"))
    return rows.join(same, "key").select("item_id", "n", "norm", "same")


# Whole documents


@query(o.BASE + """select source_id, '{"chunk_id":"' || source_id || '#' || seq || '","level":' || level || ',"chunk_type":"' || chunk_type || '","start_offset":' || cast(start_offset as bigint) || '}' as json from sections""")
def json_export(s, d):
    return as_json(_sections(s, d), ["chunk_id", "level", "chunk_type", "start_offset"])


@query("""with docs as (select cast(conv_id as varchar) as source_id, turn, '# ' || role || chr(10) || regexp_replace(text, '[\\r\\n]', ' ', 'g') as t from conversations)
select source_id, row_number() over (partition by source_id order by turn) as seq, regexp_extract(t, '^# ([a-z]+)', 1) as clean_title, regexp_replace(substr(t, instr(t, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') as content from docs""")
def conversation_sections(s, d):
    turn = F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.regexp_replace("text", r"[\r\n]", " "))
    rows = _table(s, d, "conversations").select("conv_id", "turn", turn.alias("t"))
    docs = rows.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return structure.sections(docs).select("source_id", "seq", "clean_title", "content")


@query(o.BASE + "select count(*) as n_chunks, cast(sum(length(content)) as bigint) as n_chars, count(distinct source_id) as n_documents from sections")
def corpus_summary(s, d):
    rows = _sections(s, d)
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).cast("bigint").alias("n_chars"), F.count_distinct("source_id").alias("n_documents"))


@query(o.BASE + "select source_id, seq, clean_title from sections where cast(source_id as bigint) % 3 <> 0")
def blank_documents(s, d):
    """Documents of white space alone, a third of all, give no sections; the guard leaves all others."""
    some = F.col("source_id").cast("bigint") % 3 == 0
    rows = _docs(s, d).withColumn("text", F.when(some, F.regexp_replace("text", r"(?U)\S", " ")).otherwise(F.col("text")))
    return Chunker().process(rows).chunks.select("source_id", "seq", "clean_title")


