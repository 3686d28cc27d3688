"""Extraction of symbols and references from source and markup files."""

from .core import EXTRACTED, Record, extract, extract_files

__all__ = ["EXTRACTED", "Record", "extract", "extract_files"]
