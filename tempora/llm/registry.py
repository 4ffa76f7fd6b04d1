"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from tempora.llm.decontaminate import OP5_SQL, op5_benchmark_decontamination
from tempora.llm.jaccard import op3_ngram_jaccard_join
from tempora.llm.language import op6_language_id
from tempora.llm.lines import OP10_SQL, op10_line_dedup
from tempora.llm.media import op4_media_columns
from tempora.llm.packing import op9_packing
from tempora.llm.paragraphs import op7_substring_dedup
from tempora.llm.quality import op8_quality_classifier
from tempora.llm.secrets import OP2_SQL, op2_secret_scans
from tempora.llm.tokens import op1_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secret_scans,
        op3_ngram_jaccard_join,
        op4_media_columns,
        op5_benchmark_decontamination,
        op6_language_id,
        op7_substring_dedup,
        op8_quality_classifier,
        op9_packing,
        op10_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_secret_scans": OP2_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
}
