"""Operators for large text corpora: filters, near copies, extraction, scoring and packing."""
