"""Declared schemas of what is stored as JSON, as DDL; nothing is inferred."""

from __future__ import annotations

#: A source's own settings.
CONFIG = (
    "struct<chunk_size: int, chunk_overlap: int, min_chunk_size: int, ocr_enabled: boolean, ocr_language: string, chunking_method: string, "
    "context_window: int, doc_type: string, parent_chunk_size: int, child_chunk_size: int, symbol_separator: string>"
)
