"""Operators of a training-data pipeline; each module holds one operator and its query."""

from . import (bpe, chat_format, cross_align, decontaminate, fingerprint, html_extract, ngram_join, pii, quality, substring_dedup,  # noqa: F401
               suffix_dedup, toxicity, whitening)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
