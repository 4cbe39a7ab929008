"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, fill_middle, lexical, licences, near_dup, neighbours, packing, phrase_dedup, pii, quality, suffix_dedup, token_counts, toxicity
from .common import settled

MODULES = (pii, token_counts, quality, licences, decontamination, packing, suffix_dedup, phrase_dedup, near_dup, toxicity, fill_middle, lexical, neighbours)


def _settled(name: str, query):
    """The query's rows, written once; its intermediate tables are gone when it returns."""
    return lambda spark, sf_dir: settled(spark, name, lambda: query(spark, sf_dir))


def queries() -> dict:
    return {k: _settled(k, f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
