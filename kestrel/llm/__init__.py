"""Operators for preparing text corpora: tokenising, scoring, filtering,
near-duplicate detection and mixing. Nothing else in the library imports this
subpackage."""
