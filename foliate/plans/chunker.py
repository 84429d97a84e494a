"""The engine's front: a chunker turns documents into chunks, or into a graph of chunks, elements and edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.rules import DEFAULT_RULES, Rule, ordered
from foliate.operators import elements as el
from foliate.operators import graph
from foliate.operators.keywords import EXTRACTORS, combined, inherited_from_parents
from foliate.operators.markdown import blocks
from foliate.operators.sizing import overlapped, split_sections
from foliate.operators.structure import each, section_array, with_ids
from foliate.plans.config import ChunkerConfig
from foliate.sources.documents import checked, from_table


@dataclass(frozen=True)
class DocumentGraph:
    """Three lazy tables that share ``source_id``. Without structure, elements and edges are None."""

    chunks: DataFrame
    elements: DataFrame | None = None
    edges: DataFrame | None = None
    #: Parsed documents, where the chunker has them: what is asked of elements and edges together takes one parse.
    parsed: DataFrame | None = None

    @property
    def has_structure(self) -> bool:
        return self.elements is not None

    def root_elements(self) -> DataFrame:
        return el.root_elements(self.parsed) if self.parsed is not None else graph.root_elements(self.elements, self.edges)

    def child_elements(self, element_id: str) -> DataFrame:
        if self.parsed is not None:
            return el.child_elements(self.parsed, F.col("parent_element_id") == element_id)
        return graph.child_elements(self.elements, self.edges, element_id)

    def parent_elements(self) -> DataFrame:
        return el.parent_elements(self.parsed) if self.parsed is not None else graph.parent_elements(self.elements, self.edges)


class Chunker:
    """Chunks by line patterns, or with ``structure_first`` by Markdown blocks.

    ``strategy`` replaces both: a function from documents (source_id, text) to chunks with source_id, chunk_id, parent_id,
    clean_title and content. ``extractor`` is ``simple``, ``cleaned`` or a function of (content, k) that gives an array column. Without a
    config nothing is split or overlapped and ten keywords are extracted. All tables are lazy; a plan of the pattern
    path has no exchange unless keywords are inherited.
    """

    def __init__(self, config: ChunkerConfig | None = None, rules: Sequence[Rule] = DEFAULT_RULES, extractor: str | Callable[[Column, int], Column] = "simple", structure_first: bool = False, strategy: Callable[[DataFrame], DataFrame] | None = None):
        self.config = config.validate() if config is not None else None
        self.rules = ordered(rules)
        self.extract = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor
        if self.extract is None:
            raise ValueError("an extractor is needed")
        self.structure_first = structure_first
        self.strategy = strategy

    @classmethod
    def create_structure_first(cls, config: ChunkerConfig | None = None) -> Chunker:
        return cls(config, structure_first=True)

    def _with_keywords(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with their keywords, and an empty ``metadata`` map where a strategy gives none."""
        c = self.config or ChunkerConfig()
        if "metadata" not in chunks.columns:
            chunks = chunks.withColumn("metadata", F.create_map().cast("map<string,string>"))
        if not c.extract_keywords:
            return chunks.withColumn("keywords", F.array().cast("array<string>"))
        k = c.max_keywords_per_chunk
        words = combined(self.extract(F.col("content"), k), F.col("clean_title"), c.custom_keywords, c.section_keyword_mappings, k=k)
        chunks = chunks.withColumn("keywords", words)
        return inherited_from_parents(chunks, k) if c.inherit_parent_keywords else chunks

    def sections(self, docs: DataFrame) -> DataFrame:
        """(source_id, sections): the chunks of a document as an array in its row; also for streams."""
        c = self.config
        found = section_array(F.col("text"), self.rules, bool(c and c.preserve_original_markdown))
        if c:
            parts = split_sections(found, c.max_chunk_size, c.split_on_sentences)
            found = overlapped(parts, c.chunk_overlap)
        return docs.select("source_id", found.alias("sections"))

    def process(self, docs: DataFrame, strict: bool = False) -> DocumentGraph:
        """Chunks of documents (source_id, text). Blank ones give none; with ``strict`` they stop the query."""
        docs = checked(docs, strict)
        if self.strategy:
            return DocumentGraph(self._with_keywords(self.strategy(docs)))
        if self.structure_first:
            return DocumentGraph(self._with_keywords(el.block_chunks(blocks(docs))))
        rows = each(self.sections(docs), "sections").select("source_id", "sections.*")
        return DocumentGraph(self._with_keywords(with_ids(rows)))

    def chunk(self, rows: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
        """Chunks of a table's texts; without an id column a hash of the text is the source_id."""
        return self.process(from_table(rows, id_col, text_col)).chunks

    def process_with_structure(self, docs: DataFrame, strict: bool = False) -> DocumentGraph:
        """Chunks, elements and edges. A pattern chunker has no structure to give: chunks alone.

        Parsing is deterministic, so each table may parse anew; persist ``docs`` or write the tables to parse once.
        """
        if not self.structure_first or self.strategy:
            return self.process(docs, strict)
        parsed = blocks(checked(docs, strict))
        return DocumentGraph(self._with_keywords(el.block_chunks(parsed)), el.elements(parsed), el.edges(parsed), parsed)
