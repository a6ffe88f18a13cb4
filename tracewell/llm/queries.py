"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import op3_chat_windows
from .clustering import CLUSTERING_SQL, op13_centroid_clustering
from .decontam import op7_decontamination
from .jaccard_join import op9_jaccard_join
from .lexical_search import LEXICAL_SEARCH_SQL, op11_lexical_search
from .line_dedup import LINE_DEDUP_SQL, op4_line_dedup
from .lm_score import op12_lm_scoring
from .packing import op1_best_fit_packing
from .pii import op6_pii
from .quality import op10_quality_rules
from .repeats import op8_suffix_dedup
from .toxicity import op2_toxicity
from .warc import WARC_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_chat_windows, op4_line_dedup, op5_warc, op6_pii, op7_decontamination, op8_suffix_dedup, op9_jaccard_join, op10_quality_rules, op11_lexical_search, op12_lm_scoring, op13_centroid_clustering)}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "op5_warc": WARC_SQL, "op11_lexical_search": LEXICAL_SEARCH_SQL, "op13_centroid_clustering": CLUSTERING_SQL}
