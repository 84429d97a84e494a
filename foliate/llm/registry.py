"""Queries of the subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from foliate.llm import archive, decontamination, language_id, licenses, mixing, packing, quality, secrets, simhash, token_files
from foliate.llm.base import table


def queries() -> dict:
    return {
        "op1_language_id": lambda s, d: language_id.language_query(table(s, d, "documents")),
        "op2_harmonic_packing": lambda s, d: packing.packing_query(table(s, d, "documents")),
        "op3_secret_ownership": lambda s, d: secrets.secret_query(table(s, d, "documents")),
        "op4_license_notices": lambda s, d: licenses.license_query(table(s, d, "documents")),
        "op5_token_records": lambda s, d: token_files.token_file_query(table(s, d, "documents")),
        "op6_warc_archive": lambda s, d: archive.archive_query(table(s, d, "pages")),
        "op7_simhash_anchors": lambda s, d: simhash.simhash_query(table(s, d, "documents")),
        "op8_context_mixing": lambda s, d: mixing.mixing_query(table(s, d, "documents")),
        "op9_quality_thresholds": lambda s, d: quality.quality_query(table(s, d, "documents"), table(s, d, "labels")),
        "op10_decontamination": lambda s, d: decontamination.decontamination_query(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_ownership": secrets.SECRET_SQL,
        "op6_warc_archive": archive.ARCHIVE_SQL,
        "op10_decontamination": decontamination.DECONTAMINATION_SQL,
    }
