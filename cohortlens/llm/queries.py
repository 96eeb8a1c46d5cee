"""The queries of this subpackage, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, filter_audit, hard_negatives, mixing, near_dup, packing, pii, quality, secret_scan, sharding, substring_dedup, warc
from .common import table

QUERIES = {
    "op1_sharding": lambda spark, d: sharding.op1(spark, table(spark, d, "documents")),
    "op2_mixing": lambda spark, d: mixing.op2(spark, table(spark, d, "documents")),
    "op3_quality": lambda spark, d: quality.op3(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_warc": lambda spark, d: warc.op4(spark, table(spark, d, "pages")),
    "op5_near_dup": lambda spark, d: near_dup.op5(spark, table(spark, d, "documents")),
    "op6_pii": lambda spark, d: pii.op6(spark, table(spark, d, "documents")),
    "op7_exact_dedup": lambda spark, d: exact_dedup.op7(spark, table(spark, d, "documents")),
    "op8_decontamination": lambda spark, d: decontamination.op8(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_secret_scan": lambda spark, d: secret_scan.op9(spark, table(spark, d, "documents")),
    "op10_substring_dedup": lambda spark, d: substring_dedup.op10(spark, table(spark, d, "documents")),
    "op11_hard_negatives": lambda spark, d: hard_negatives.op11(spark, table(spark, d, "embeddings")),
    "op12_packing": lambda spark, d: packing.op12(spark, table(spark, d, "documents")),
    "op13_filter_audit": lambda spark, d: filter_audit.op13(spark, table(spark, d, "documents"), table(spark, d, "labels")),
}
ORACLES = {"op10_substring_dedup": substring_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_filter_audit": filter_audit.ORACLE, "op2_mixing": mixing.ORACLE, "op4_warc": warc.ORACLE, "op5_near_dup": near_dup.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op8_decontamination": decontamination.ORACLE}
