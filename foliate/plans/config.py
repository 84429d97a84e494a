"""Options of a chunking plan, presets and their validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from foliate.functions.patterns import java_error, slow_error


@dataclass(frozen=True)
class ChunkerConfig:
    """Options of a chunker.

    ``respect_section_boundaries``, ``include_heading_hierarchy``, ``calculate_offsets``, ``min_chunk_size`` and
    ``preserve_structure`` are accepted and validated but change no result: offsets and paths are always there,
    and small chunks are never merged. ``prioritize_custom_keywords`` changes no result either, as custom keywords
    come first both ways.
    """

    max_chunk_size: int = 1000
    chunk_overlap: int = 200
    preserve_structure: bool = True
    min_chunk_size: int = 100
    split_on_sentences: bool = True
    respect_section_boundaries: bool = True
    include_heading_hierarchy: bool = True
    extract_keywords: bool = True
    max_keywords_per_chunk: int = 10
    calculate_offsets: bool = True
    preserve_original_markdown: bool = False
    custom_keywords: Sequence[str] = ()
    section_keyword_mappings: Mapping[str, Sequence[str]] = field(default_factory=dict)
    prioritize_custom_keywords: bool = True
    inherit_parent_keywords: bool = False

    def validate(self) -> ChunkerConfig:
        """Itself, or ValueError for the first option that is out of range."""
        wrong = [
            (self.max_chunk_size <= 0, "max_chunk_size must be greater than 0"),
            (self.min_chunk_size <= 0, "min_chunk_size must be greater than 0"),
            (self.min_chunk_size >= self.max_chunk_size, "min_chunk_size must be less than max_chunk_size"),
            (self.chunk_overlap < 0, "chunk_overlap cannot be negative"),
            (self.chunk_overlap >= self.max_chunk_size, "chunk_overlap must be less than max_chunk_size"),
            (self.max_keywords_per_chunk <= 0, "max_keywords_per_chunk must be greater than 0"),
            (any(not (k or "").strip() for k in self.custom_keywords), "custom_keywords cannot hold blank values"),
        ]
        for bad, message in wrong:
            if bad:
                raise ValueError(message)
        for pattern, words in self.section_keyword_mappings.items():
            if not (pattern or "").strip():
                raise ValueError("section_keyword_mappings cannot hold a blank pattern")
            if any(not (k or "").strip() for k in words):
                raise ValueError(f"section_keyword_mappings: pattern '{pattern}' holds blank keywords")
            if said := java_error(pattern) or slow_error(pattern):
                raise ValueError(f"section_keyword_mappings: invalid pattern '{pattern}': {said}")
        return self

    @classmethod
    def default(cls) -> ChunkerConfig:
        return cls()

    # fixed values: the presets' sizes
    @classmethod
    def large_documents(cls) -> ChunkerConfig:
        return cls(max_chunk_size=2000, chunk_overlap=400, min_chunk_size=200)

    @classmethod
    def small_documents(cls) -> ChunkerConfig:
        return cls(max_chunk_size=500, chunk_overlap=100, min_chunk_size=50)

    @classmethod
    def performance(cls) -> ChunkerConfig:
        off = dict.fromkeys(
            ("preserve_structure", "split_on_sentences", "respect_section_boundaries", "include_heading_hierarchy", "extract_keywords", "calculate_offsets", "preserve_original_markdown"), False
        )
        return cls(max_chunk_size=1500, chunk_overlap=150, min_chunk_size=150, **off)

    @classmethod
    def with_custom_keywords(cls, keywords: Sequence[str], mappings: Mapping[str, Sequence[str]] | None = None) -> ChunkerConfig:
        return cls(custom_keywords=tuple(keywords), section_keyword_mappings=dict(mappings or {}), max_keywords_per_chunk=max(10, len(keywords) + 5))

    @classmethod
    def document_mapping(cls, keywords: Sequence[str], mappings: Mapping[str, Sequence[str]] | None = None) -> ChunkerConfig:
        return cls(custom_keywords=tuple(keywords), section_keyword_mappings=dict(mappings or {}), inherit_parent_keywords=True, max_keywords_per_chunk=15)
