"""The queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from tidemark.llm import canonical, chunking, frequency, language, leakage, lookalike, mixing, subjects

QUERIES = {
    "p1_found": subjects.p1_found,
    "p1_composition": subjects.p1_composition,
    "p2_found": lookalike.p2_found,
    "p2_classes": lookalike.p2_classes,
    "p2_canonical": lookalike.p2_canonical,
    "p3_found": language.p3_found,
    "p3_segments": language.p3_segments,
    "p4_found": frequency.p4_found,
    "p4_counts": frequency.p4_counts,
    "p5_found": canonical.p5_found,
    "p5_unmatched": canonical.p5_unmatched,
    "p6_found": leakage.p6_found,
    "p6_leaks": leakage.p6_leaks,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": chunking.p8_found,
    "p8_pieces": chunking.p8_pieces,
}

SQL = dict(frequency.SQL)
