"""The queries of this package and their SQL."""

from __future__ import annotations

from . import decontamination, flac_media, katz_lm, language_id, license_scan, line_dedup, mixing, ngram_join, suffix_dedup, toxicity

MODULES = [suffix_dedup, mixing, language_id, flac_media, license_scan, toxicity, ngram_join, decontamination, katz_lm, line_dedup]


def queries():
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql():
    return {m.QUERY: m.SQL for m in MODULES if m.SQL}
