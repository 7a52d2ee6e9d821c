"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bitplanes, decontam, langid, line_dedup, mixing, secrets, simhash, suffix_dedup, token_counts
from .common import read


def _on(table, make):
    return lambda spark, sf_dir: make(read(spark, sf_dir, table))


def _leaks(spark, sf_dir):
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_cgk_decontamination": _leaks,
    "op2_token_counts": _on("documents", token_counts.histogram),
    "op3_line_dedup": _on("documents", line_dedup.deduped),
    "op4_stable_projections": _on("embeddings", ann.neighbours),
    "op5_token_planes": _on("documents", bitplanes.digests),
    "op6_linked_secrets": _on("documents", secrets.report),
    "op7_language_bitmasks": _on("documents", langid.identify),
    "op8_simhash_anchors": _on("documents", simhash.classes),
    "op9_mix_sources": _on("documents", mixing.mixed_sizes),
    "op10_suffix_sort": _on("documents", suffix_dedup.digests),
}

ORACLES = {
    "op3_line_dedup": line_dedup.LINES_SQL,
    "op9_mix_sources": mixing.MIX_SQL,
}
