"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP12_SQL, op12_collocations
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .html_text import op5_html
from .language import op1_language_id
from .nearest import op4_nearest
from .packing import op9_packing
from .parsing import op11_fingerprints
from .pieces import op2_sentencepiece
from .quality import op3_quality
from .runs import op13_periodic_runs
from .simhash import op8_simhash
from .token_counts import op6_token_counts
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sentencepiece,
        op3_quality,
        op4_nearest,
        op5_html,
        op6_token_counts,
        op7_toxicity,
        op8_simhash,
        op9_packing,
        op10_embedding_dedup,
        op11_fingerprints,
        op12_collocations,
        op13_periodic_runs,
    )
}
ORACLE: dict[str, str] = {"op10_embedding_dedup": OP10_SQL, "op12_collocations": OP12_SQL}
