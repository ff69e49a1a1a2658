"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm.chat import OP4_SQL, op4_chat_format
from tidemark.llm.decontaminate import OP3_SQL, op3_decontaminate
from tidemark.llm.flac import op8_media_flac
from tidemark.llm.html import op6_html_text
from tidemark.llm.jaccard import OP10_SQL, op10_jaccard_join
from tidemark.llm.language import op5_language_id
from tidemark.llm.mixing import OP2_SQL, op2_mix_sources
from tidemark.llm.quality import op7_quality_classifier
from tidemark.llm.repeats import op9_repeats
from tidemark.llm.secrets import op1_secret_scan

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_html_text": op6_html_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_media_flac": op8_media_flac,
    "op9_repeats": op9_repeats,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLES: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op10_jaccard_join": OP10_SQL,
}
