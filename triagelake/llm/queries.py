"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from .bpe import op4_bpe
from .language import op6_language
from .line_dedup import OP1_SQL, op1_line_dedup
from .lm_score import op7_lm_score
from .media import op9_media
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op5_near_dedup
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .topk import OP3_SQL, op3_topk
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_topk": op3_topk,
    "op4_bpe": op4_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_language": op6_language,
    "op7_lm_score": op7_lm_score,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_media": op9_media,
    "op10_warc": op10_warc,
}
SQL = {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op3_topk": OP3_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc": OP10_SQL}
