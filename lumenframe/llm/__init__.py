"""Operators and queries for training-data work. Nothing else in the library imports this."""

import importlib

from .registry import ORACLES, QUERIES

for _name in ("html_main", "language_id", "suffix_dedup", "decontaminate", "jaccard_join", "secret_scan", "line_dedup", "chat_format", "bpe", "learned_index",
              "hard_negatives", "source_mix", "spelling_variants"):
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
