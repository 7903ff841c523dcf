"""Operators on text corpora: quality, duplicates, contamination, mixing and the like."""
