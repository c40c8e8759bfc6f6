"""The pN_ queries."""

from __future__ import annotations

import os
import secrets

from lodestrata.llm import ann, dedup, lines, mix, mojibake, pii, scans, tokens
from lodestrata.session import table


def p1_found(spark, d):
    return dedup.found(table(spark, d, "documents"), table(spark, d, "chunks"))


def p2_found(spark, d):
    return scans.found(table(spark, d, "chunks"))


def p2_repaired(spark, d):
    return scans.repaired(table(spark, d, "chunks"))


def p3_found(spark, d):
    return ann.found(table(spark, d, "chunk_vectors"))


def p3_neighbours(spark, d):
    return ann.neighbours(table(spark, d, "chunk_vectors"), probes=ann.growing_probes, beam=None, shard=ann.WIDE_SHARD, queries=table(spark, d, "chunks").select("embedding_row"))


def p4_found(spark, d):
    return lines.found(table(spark, d, "chunks"), table(spark, d, "documents"))


def p4_cleaned(spark, d):
    return lines.cleaned(table(spark, d, "chunks"), table(spark, d, "documents"))


def p5_found(spark, d):
    return pii.found(table(spark, d, "requests"), table(spark, d, "chunks"), table(spark, d, "staff"))


def p5_masked(spark, d):
    """The key is LODESTRATA_PII_KEY (hexadecimal). Without one a run draws its own, which nobody keeps: values are linked within the run only."""
    key = os.environ.get("LODESTRATA_PII_KEY")
    return pii.masked(table(spark, d, "requests"), table(spark, d, "chunks"), table(spark, d, "staff"), bytes.fromhex(key) if key else secrets.token_bytes(32))


def p6_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p7_mix(spark, d):
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark, d):
    return mojibake.found(table(spark, d, "documents"))


def p8_repaired(spark, d):
    return mojibake.repaired(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_found, p3_neighbours, p4_found, p4_cleaned, p5_found, p5_masked, p6_ids, p7_mix, p7_shares, p8_found, p8_repaired)}


def oracle_sql() -> dict[str, str]:
    from lodestrata.llm import sql

    return sql.ORACLE
