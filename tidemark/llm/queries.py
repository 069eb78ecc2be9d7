"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from .chat import op1_chat_format
from .decontaminate import OP2_SQL, op2_decontaminate
from .embeddings import OP8_SQL, op8_embedding_dedup
from .html import op10_html_extract
from .jaccard import OP6_SQL, op6_jaccard_join
from .lm import op5_lm_score
from .mixing import OP3_SQL, op3_mix
from .quality import op4_quality
from .toxicity import op7_toxicity
from .urls import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix": op3_mix,
    "op4_quality": op4_quality,
    "op5_lm_score": op5_lm_score,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
}

SQL = {"op2_decontaminate": OP2_SQL, "op3_mix": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}
