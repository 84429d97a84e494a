"""SQL of another shape for the queries: windows, joins and recursion where the plans fold arrays."""

from __future__ import annotations

from foliate.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

BASE = """
with recursive split as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from (select doc_id, regexp_split_to_array(text, '[\\r\\n]') as a from documents)),
overlay as (
  select doc_id, pos, case when length(line) = 0 then line else case cast((doc_id * 7 + pos * 13) % 16 as int)
    when 0 then '# ' || line when 1 then '## ' || line when 2 then '### ' || line
    when 3 then case pos % 3 when 0 then '1. ' when 1 then '1.2 ' else '1.2.3 ' end || line when 4 then '§ 42 ' || line
    when 5 then 'Appendix A: ' || line when 6 then 'B. ' || line when 7 then 'IV. ' || line
    when 8 then '#### ' || line when 9 then '##### ' || line when 10 then '###### ' || line else line end end as line
  from split),
placed as (
  select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as start_offset,
    sum(length(line) + 1) over (partition by doc_id) - 1 as size from overlay),
typed as (
  select *, case when trim(line) = '' then null when regexp_matches(line, '^#\\s+') then 'MarkdownH1' when regexp_matches(line, '^##\\s+') then 'MarkdownH2'
    when regexp_matches(line, '^###\\s+') then 'MarkdownH3' when regexp_matches(line, '^####\\s+') then 'MarkdownH4' when regexp_matches(line, '^#####\\s+') then 'MarkdownH5'
    when regexp_matches(line, '^######\\s+') then 'MarkdownH6' when regexp_matches(line, '^\\d+(\\.\\d+)*\\.?\\s+') then 'Numeric' when regexp_matches(line, '^§\\s*\\d+\\s+') then 'Legal'
    when regexp_matches(line, '^Appendix\\s+[A-Z][\\.:\\-\\s]+') then 'Appendix' when regexp_matches(line, '^[IVX]+\\.\\s+') then 'Roman' when regexp_matches(line, '^[A-Z]\\.\\s+') then 'Letter' end as type
  from placed),
titled as (
  select *, trim(line) as raw_title, trim(case type when 'Numeric' then regexp_replace(line, '^\\d+(\\.\\d+)*\\.?\\s+', '') when 'Legal' then regexp_replace(line, '^§\\s*\\d+\\s+', '')
      when 'Appendix' then regexp_replace(line, '^Appendix\\s+[A-Z][\\.:\\-\\s]+', '') when 'Roman' then regexp_replace(line, '^[IVX]+\\.\\s+', '')
      when 'Letter' then regexp_replace(line, '^[A-Z]\\.\\s+', '') else regexp_replace(line, '^#+\\s+', '') end) as clean_title,
    case when type like 'MarkdownH%' then cast(right(type, 1) as int)
      when type = 'Numeric' then cast(length(regexp_replace(rtrim(regexp_extract(line, '^(\\d+(\\.\\d+)*\\.?)', 1), '.'), '[^.]', '', 'g')) + 1 as int) else 1 end as level,
    count(type) over (partition by doc_id order by pos) as sec
  from typed),
heads as (
  select cast(doc_id as varchar) as source_id, sec as seq, pos, start_offset, size, type, level, raw_title, clean_title, lead(start_offset) over (partition by doc_id order by pos) as following
  from titled where type is not null),
bodies as (
  select cast(doc_id as varchar) as source_id, sec as seq, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as content
  from titled where type is null and sec > 0 group by doc_id, sec),
tree as (select h.*, (select max(p.seq) from heads p where p.source_id = h.source_id and p.seq < h.seq and p.level < h.level) as parent_seq from heads h),
sections as (
  select t.source_id, t.seq, t.type as chunk_type, t.level, t.raw_title, t.clean_title, coalesce(b.content, '') as content, t.start_offset, t.parent_seq, t.pos,
    case when coalesce(b.content, '') = '' then t.start_offset else coalesce(t.following - 1, t.size) end as end_offset
  from tree t left join bodies b using (source_id, seq))
"""

_SENTENCES = """,
cut as (select source_id, seq, list_filter(string_split(regexp_replace(content, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\\S')) as s from sections)"""
_PACK = """,
packed as (
  select c.source_id, c.seq, list_transform(list_filter(list_append(r.p, r.c), lambda x: length(x) > 0), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as parts
  from (select source_id, seq, case when len({list}) = 0 then {{'p': cast([] as varchar[]), 'c': ''}} else list_reduce(list_transform({list}, lambda x: {{'p': cast([] as varchar[]), 'c': x}}),
      lambda x, y: {step}, {{'p': cast([] as varchar[]), 'c': ''}}) end as r from {source}) c)"""
_PAD = "case when y.c like '% ' then '' else ' ' end"
SENTENCE_PACK = _SENTENCES + _PACK.format(
    list="s", source="cut",
    step="case when length(x.c) + length(y.c) > {max} and length(x.c) > 0 then {{'p': list_append(x.p, x.c), 'c': y.c || PAD}} else {{'p': x.p, 'c': x.c || y.c || PAD}} end".replace("PAD", _PAD).replace("{{", "{").replace("}}", "}"),
)
WORD_PACK = """,
cut as (select source_id, seq, list_filter(regexp_split_to_array(content, '[ \\t\\n\\r]+'), lambda w: w <> '') as s from sections)""" + _PACK.format(
    list="s", source="cut",
    step="case when length(x.c) + length(y.c) + 1 > {max} and length(x.c) > 0 then {'p': list_append(x.p, x.c), 'c': y.c} when length(x.c) > 0 then {'p': x.p, 'c': x.c || ' ' || y.c} else {'p': x.p, 'c': y.c} end",
)

TOKENS = """,
tokens as (
  select source_id, seq, lower(w) as word from (select source_id, seq, unnest(regexp_split_to_array(TEXT, '[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+')) as w from sections)
  where regexp_full_match(w, '[a-zA-Z]+') and length(w) >= 3 and lower(w) not in (STOP)),
ranked as (
  select source_id, seq, word, n, row_number() over (partition by source_id, seq order by n desc, word) as rank
  from (select source_id, seq, word, count(*) as n from tokens group by all))""".replace("STOP", _STOP)

_SPLIT_KEYWORDS = """,
keywords as (select source_id || '#' || seq as chunk_id, rank, word as keyword from ranked where rank <= 10)"""


def tokens(text: str = "content") -> str:
    return TOKENS.replace("TEXT", text) + _SPLIT_KEYWORDS


#: Blocks of the Markdown overlay: one construct each, so a CASE on the mark is a parser for them.
MARKDOWN = """
with recursive split as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from (select doc_id, regexp_split_to_array(text, '[\\r\\n]') as a from documents)),
kept as (select doc_id, pos, cast((doc_id * 7 + pos * 13) % 16 as int) as k, trim(regexp_replace(line, '[^A-Za-z0-9 .,]', '', 'g'), ' ') as t from split),
blocks as (
  select cast(doc_id as varchar) as source_id, doc_id, pos, k, t, row_number() over (partition by doc_id order by pos) as ord,
    case k when 0 then '# ' || t when 1 then '## ' || t when 2 then '#### ' || t when 3 then '- ' || t when 4 then 'See [doc' || pos || '](./d' || doc_id || '.md) ' || t
      when 5 then 'Go [site](https://x.org/' || doc_id || ') ' || t when 6 then '```' || chr(10) || t || chr(10) || '```' when 7 then 'Mail [m](mailto:a@b.c) and [s](#s' || pos || ') ' || t else 'Text ' || t end as md,
    case when k < 3 then 'heading' when k = 3 then 'list' when k = 6 then 'code_block' else 'paragraph' end as kind,
    case k when 0 then 1 when 1 then 2 when 2 then 4 else 0 end as level,
    case when k < 3 then t when k = 3 then '• ' || t when k = 4 then 'See doc' || pos || ' ' || t when k = 5 then 'Go site ' || t when k = 6 then t when k = 7 then 'Mail m and s ' || t else 'Text ' || t end as content
  from kept where t <> ''),
spans as (
  select *, cast(coalesce(sum(length(md) + 2) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
    cast(coalesce(sum(2 + case when k = 6 then 2 else 0 end) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as line from blocks),
links as (
  select source_id, ord, 0 as n, './d' || doc_id || '.md' as url, 'doc' || pos as text, 'Internal' as type from blocks where k = 4
  union all select source_id, ord, 0, 'https://x.org/' || doc_id, 'site', 'External' from blocks where k = 5
  union all select source_id, ord, 0, 'mailto:a@b.c', 'm', 'Email' from blocks where k = 7
  union all select source_id, ord, 1, '#s' || pos, 's', 'Anchor' from blocks where k = 7),
elements as (
  select source_id, source_id || '#e' || ord as element_id, kind as element_type, content, level, start as start_offset, start + length(md) - 1 as end_offset, line as start_line, md as original_markdown from spans
  union all select source_id, source_id || '#e' || ord || 'l1', 'link', text, 0, 0, 0, 0, '' from links where type = 'Internal'),
headings as (select source_id, ord, level from blocks where kind = 'heading'),
edges as (
  select h.source_id, p.ord as a, source_id || '#e' || p.ord as source_element_id, source_id || '#e' || h.ord as target_element_id, case when h.level - p.level = 1 then 'HAS_SUBSECTION' else 'HAS_NESTED_SECTION' end as relationship_type
  from headings h join headings p using (source_id)
  where p.ord = (select max(q.ord) from headings q where q.source_id = h.source_id and q.ord < h.ord and q.level < h.level)
  union all
  select source_id, c, source_id || '#e' || c, source_id || '#e' || ord, 'CONTAINS'
  from (select source_id, ord, kind, max(case when kind = 'heading' then ord end) over (partition by source_id order by ord) as c from blocks) where kind <> 'heading' and c is not null
  union all select source_id, ord, source_id || '#e' || ord, source_id || '#e' || ord || 'l1', 'LINKS_TO' from links where type = 'Internal')
"""
