"""Queries of the text-corpus operators, one per operator, and their DuckDB spelling where SQL has one."""

from __future__ import annotations

from funnelspark.llm.classifier import op5_quality_classifier
from funnelspark.llm.fingerprints import op10_simhash
from funnelspark.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from funnelspark.llm.html_text import OP3_SQL, op3_html_extraction
from funnelspark.llm.jaccard_join import op1_jaccard_join
from funnelspark.llm.license_scan import op13_license_scan
from funnelspark.llm.line_dedup import OP4_SQL, op4_line_dedup
from funnelspark.llm.merkle import OP11_SQL, op11_merkle_manifest
from funnelspark.llm.mixing import op9_mixing
from funnelspark.llm.packing import op8_best_fit_packing
from funnelspark.llm.quality_rules import op7_quality_rules
from funnelspark.llm.sharding import op6_sharding
from funnelspark.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}

#: The others are tested against brute force, an exact round trip or held-out labels.
ORACLE_SQL = {"op2_warc": OP2_SQL, "op3_html_extraction": OP3_SQL, "op4_line_dedup": OP4_SQL, "op11_merkle_manifest": OP11_SQL,
              "op12_hard_negatives": OP12_SQL}
