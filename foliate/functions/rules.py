"""Prioritized line patterns that recognize headings, compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.patterns import java_error, java_groups
from foliate.functions.text import is_blank, trim_all

MATCH = "struct<type:string,level:int,raw_title:string,clean_title:string>"


@dataclass(frozen=True, kw_only=True)
class Rule:
    """A heading pattern. Without a level, type Numeric takes the depth of its number and any other takes 1."""

    type: str
    pattern: str
    level: int | None = None
    priority: int = 0

    def __post_init__(self):
        if not self.type.strip() or not self.pattern:
            raise ValueError("a rule needs a type and a pattern")
        if self.level is not None and self.level < 1:
            raise ValueError("a rule's level starts at 1")
        if said := java_error(self.pattern):
            raise ValueError(f"a rule's pattern is no pattern: {said}")

    @property
    def groups(self) -> int:
        return java_groups(self.pattern)

    @property
    def java(self) -> str:
        """White space, digits and letters of all scripts; a dot takes anything but a line feed, which no line holds."""
        return "(?sU)" + self.pattern


#: The default patterns with their levels and priorities.
DEFAULT_RULES = (
    Rule(type="MarkdownH1", pattern=r"^#\s+(.*)", level=1, priority=1),
    Rule(type="MarkdownH2", pattern=r"^##\s+(.*)", level=2, priority=2),
    Rule(type="MarkdownH3", pattern=r"^###\s+(.*)", level=3, priority=3),
    Rule(type="MarkdownH4", pattern=r"^####\s+(.*)", level=4, priority=4),
    Rule(type="MarkdownH5", pattern=r"^#####\s+(.*)", level=5, priority=5),
    Rule(type="MarkdownH6", pattern=r"^######\s+(.*)", level=6, priority=6),
    Rule(type="Numeric", pattern=r"^(\d+(?:\.\d+)*\.?)\s+(.*)", priority=10),
    Rule(type="Legal", pattern=r"^(§\s*\d+)\s+(.*)", priority=20),
    Rule(type="Appendix", pattern=r"^Appendix\s+([A-Z])[\.:\-\s]+(.*)", priority=30),
    Rule(type="Roman", pattern=r"^([IVX]+)\.\s+(.*)", priority=40),
    Rule(type="Letter", pattern=r"^([A-Z])\.\s+(.*)", priority=50),
)


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    if not rules:
        raise ValueError("at least one rule is needed")
    return sorted(rules, key=lambda r: r.priority)


def _level(rule: Rule, line: Column) -> Column:
    if rule.level is not None:
        return F.lit(rule.level)
    if rule.type != "Numeric" or not rule.groups:
        return F.lit(1)
    number = F.regexp_replace(F.regexp_extract(line, rule.java, 1), r"\.+$", "")
    return F.length(number) - F.length(F.regexp_replace(number, r"\.", "")) + 1


def match_line(line: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """The match of the first rule that fits, null for blank lines and lines that fit none."""
    out = F.when(is_blank(line), F.lit(None).cast(MATCH))
    for rule in ordered(rules):
        out = out.when(
            line.rlike(rule.java),
            F.struct(
                F.lit(rule.type).alias("type"), _level(rule, line).cast("int").alias("level"), trim_all(F.regexp_extract(line, rule.java, 0)).alias("raw_title"),
                trim_all(F.regexp_extract(line, rule.java, rule.groups)).alias("clean_title"),
            ).cast(MATCH),
        )
    return out.otherwise(F.lit(None).cast(MATCH))


def chunk_kind(type_: Column, raw_title: Column) -> Column:
    """Header for headings; else by what the type's name holds, checked in this order."""
    low = F.lower(type_)
    heading = is_heading(type_, raw_title)
    out = F.when(heading, "Header")
    # fixed values: the parts of names and the kinds they stand for, in this order
    for part, kind in (
        ("list", "ListItem"), ("table", "Table"), ("code", "CodeBlock"), ("quote", "Quote"), ("legal", "Legal"),
        ("numeric", "Numeric"), ("section", "Section"), ("appendix", "Appendix"),
    ):
        out = out.when(low.contains(part), kind)
    return out.otherwise("Content")


def is_heading(type_: Column, raw_title: Column) -> Column:
    return F.coalesce(type_.contains("Heading") | type_.contains("Markdown"), F.lit(False)) | (F.coalesce(raw_title, F.lit("")) != "")
