"""Readers: files, URLs, values and tables to documents."""

from .pdf import assemble_pages, lines_from_words, lines_outside_tables, table_is_real
from .readers import BaseReader, DoclingReader, MarkItDownReader, VanillaReader, documents_from_value, read_documents, sniff

__all__ = [
    "BaseReader",
    "DoclingReader",
    "MarkItDownReader",
    "VanillaReader",
    "assemble_pages",
    "documents_from_value",
    "lines_from_words",
    "lines_outside_tables",
    "read_documents",
    "sniff",
    "table_is_real",
]
