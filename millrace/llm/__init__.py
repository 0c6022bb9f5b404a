"""Operators that prepare text corpora: deduplication, boilerplate, splitting, repair, leakage, mixing and quality."""
