"""Operators for text corpora: parse checks, file labels, survivors, packing, leakage and shared spans."""
