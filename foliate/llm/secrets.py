"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by their patterns. A further kind, ``owned``, are tokens of 20 or more characters that mix lower
case, upper case and digits: such a token is reported only if the corpus says that it belongs to someone. A value is a widely
copied example if COPIED_OWNERS distinct owners hold it, or COPIED_REPOS distinct repositories, whoever owns them: a
credential that a second site happens to repeat stays live, an example pasted all over one site does not. The same
counts tell live-looking from copied ones among the base spans.

Places come from splitting a text by a pattern: the parts and the matches between them, laid end to end, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.folds import running
from foliate.llm.base import fresh, written

#: The patterns of the base kinds. hex and access take the least length into the pattern, as a run of
#: their characters is matched whole or not at all; assign is filtered afterwards, as a short match uses up its text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OWNED = r"[A-Za-z0-9+/_-]{20,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "owned")
#: Owners, and repositories, from which a value counts as a widely copied example.
COPIED_OWNERS = 3
COPIED_REPOS = 10

JUDGED = "struct<start:long,rank:int,kind:string,end:long,value:string,n_owners:long,n_repos:long>"
SPAN = "struct<start:long,rank:int,kind:string,end:long,value:string>"


def _matches(text: Column, kind: str, pattern: str, value_group: int) -> Column:
    """Spans of all leftmost, non-overlapping matches; places in code points, ends exclusive."""
    re = F.lit(pattern)
    found, parts = F.regexp_extract_all(text, re, F.lit(0)), F.split(text, pattern, -1)
    values = found if value_group == 0 else F.regexp_extract_all(text, re, F.lit(value_group))
    zipped = F.arrays_zip(found.alias("m"), F.slice(parts, 1, F.size(found)).alias("p"), values.alias("v"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.length(x["p"])
        b = a + F.length(x["m"])
        return b.cast("long"), F.struct(a.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), b.cast("long").alias("end"), x["v"].alias("value"))

    spans = running(zipped, F.lit(0), step, "long", SPAN)
    return F.when(F.rlike(text, re), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans, and those of further candidates that overlap none of them."""
    assign = F.filter(_matches(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE)
    base = F.concat(assign, _matches(text, "access", ACCESS, 0), _matches(text, "hex", HEX, 0))
    mixed = F.filter(_matches(text, "owned", OWNED, 0), lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    return base, mixed


def _rendered(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns in ``keep``, all by default) with ``base`` and ``spans`` (arrays of start, rank, kind, end,
    value; spans with n_owners and n_repos), ``n_live`` and ``n_copied``.

    A value's owners are the distinct non-null values of ``owner_col`` over all rows that hold it, its repositories
    those of ``repo_col``; a value without any owner counts as owned by none. A span is copied if its value has
    ``copied_owners`` owners or more or ``copied_repos`` repositories or more, else live. ``owned`` spans are kept only if live
    and free of base spans. A null or empty text has no spans, very long ones are scanned whole. Spans of one start are
    ordered by kind as listed. Repeated rows are scanned each (and are one repository); a table without rows gives none.
    Columns that bear the name of a result are replaced; no other name clashes.
    """
    keep = [c for c in keep or docs.columns if c not in ("base", "spans", "n_live", "n_copied")]
    row, more_col = fresh(keep, "_row"), fresh(keep, "_more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, more = candidates(text)
    rows = docs.select(F.monotonically_increasing_id().alias(row), *keep, base.alias("base"), more.alias(more_col))
    rows = rows.withColumn(more_col, _apart(F.col(more_col), F.col("base")))
    return _classified(written(rows, "candidates"), row, more_col, repo_col, owner_col, copied_owners, copied_repos)


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``. A token that holds a base span starts or ends in it, or around
    it; spans of a text are few, and where they are many both sides are short."""
    return F.when(F.size(base) == 0, more).otherwise(F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


def _classified(rows: DataFrame, row: str, more_col: str, repo_col: str, owner_col: str, copied_owners: int, copied_repos: int) -> DataFrame:
    some = (F.size("base") > 0) | (F.size(more_col) > 0)
    none = F.array().cast(f"array<{JUDGED}>")
    plain = rows.where(~some).select("*", none.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    # the rows' other columns, texts among them, stay out of the exchanges by value
    each = rows.where(some).select(F.col(row).alias("_row"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.explode(F.concat("base", more_col)).alias("s"))
    each = each.select("_row", "repo", "owner", "s", F.sha2("s.value", 256).alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count("owner").alias("n_owners"))
    repos = each.groupBy("hash", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count("repo").alias("n_repos"))
    counts = owners.join(repos, "hash")
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    judged = each.join(counts, "hash").select("_row", F.struct("s.*", "n_owners", "n_repos").cast(JUDGED).alias("s"), copied.alias("copied"))
    judged = judged.where(~(F.col("copied") & (F.col("s.kind") == "owned")))
    back = judged.groupBy("_row").agg(F.collect_list("s").alias("spans"), F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"))
    full = rows.where(some).join(back.withColumnRenamed("_row", row), row, "left")
    full = full.withColumns({"spans": F.coalesce("spans", none), "n_live": F.coalesce("n_live", F.lit(0)), "n_copied": F.coalesce("n_copied", F.lit(0))})
    return plain.unionByName(full).drop(row, more_col)


def ownership(rows: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """hash, n_rows, n_repos and n_owners of every candidate of the corpus; ``rows`` have the column ``spans``."""
    each = rows.select(F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count("owner").alias("n_owners"))
    by_repo = each.groupBy("hash", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count("repo").alias("n_repos"))
    return by_owner.join(by_repo, "hash").select("hash", "n_rows", "n_repos", "n_owners")


def _kind_count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def secret_query(docs: DataFrame) -> DataFrame:
    out = scan(docs, keep=["doc_id", "source"])
    return out.select(
        "doc_id", *(_kind_count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"),
        _rendered(F.col("spans")).alias("spans"), "n_live", "n_copied", *(_listed(c).alias(c) for c in ("n_owners", "n_repos")),
    )


def _listed(name: str) -> Column:
    """A number of each span, in the order of ``spans``."""
    return F.array_join(F.transform(F.array_sort("spans"), lambda s: s[name].cast("string")), ",")


MASK = "[secret]"


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a secret, base or owned, replaced by a mask; n_chars follows. Overlapping spans are
    masked once. Rows without spans, null texts among them, stay as they are."""
    columns = docs.columns
    out = scan(docs)
    text, spans = F.col("text"), F.array_sort("spans")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        lead = F.concat(F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), F.lit(MASK))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, lead)

    pieces = running(spans, F.lit(0), step, "long", "string", lambda at: F.substring(text, (at + 1).cast("int"), F.length(text)))
    whole = F.array_join(F.array_compact(pieces), "")
    masked = F.when(F.size("spans") > 0, whole).otherwise(text)
    chars = F.when(F.size("spans") > 0, F.length(masked).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[masked.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(c) for c in columns])


_SPLIT = """
  select doc_id, row, source, '{kind}' as kind, {rank} as rank, k, m[k] as match, v[k] as value,
    list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as start
  from (select doc_id, row, source, regexp_extract_all(text, $re${re}$re$) as m, regexp_extract_all(text, $re${re}$re$, {group}) as v, regexp_split_to_array(text, $re${re}$re$) as p from d),
    unnest(range(1, len(m) + 1)) as t(k)"""
SECRET_SQL = (
    "with d as (select doc_id, source, coalesce(text, '') as text, row_number() over () as row from documents), found as ("
    + " union all ".join(_SPLIT.format(kind=k, rank=i, re=p, group=g) for i, (k, p, g) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, OWNED), (2, 0, 0, 0))))
    + """),
good as (
  select *, cast(start + length(match) as bigint) as stop from found
  where case kind when 'assign' then length(value) >= 12
    when 'owned' then regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]') else true end),
apart as (
  select g.* from good g where kind <> 'owned' or not exists (
    select 1 from good b where b.row = g.row and b.kind <> 'owned' and b.start < g.stop and g.start < b.stop)),
owners as (select value, count(distinct source) as n_owners, count(distinct doc_id) as n_repos from apart group by value),
judged as (
  select a.*, n_owners, n_repos, n_owners >= 3 or n_repos >= 10 as copied from apart a join owners o using (value)
  where not (a.kind = 'owned' and (n_owners >= 3 or n_repos >= 10))),
per as (
  select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind <> 'owned') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans, count(*) filter (not copied) as n_live, count(*) filter (copied) as n_copied,
    string_agg(n_owners, ',' order by start, rank) as owners, string_agg(n_repos, ',' order by start, rank) as repos
  from judged group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied,
  coalesce(owners, '') as n_owners, coalesce(repos, '') as n_repos
from d left join per using (row)
"""
)
