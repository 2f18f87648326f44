"""The training-data operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from concord.llm.collocations import OP11_SQL, op11_collocations
from concord.llm.fingerprints import op2_fingerprints
from concord.llm.html_text import op6_html_text
from concord.llm.mixing import op10_mixing
from concord.llm.negatives import OP12_SQL, op12_negatives
from concord.llm.packing import op3_packing
from concord.llm.quality import op1_quality
from concord.llm.signature_tree import OP13_SQL, op13_jaccard
from concord.llm.simhash import op7_simhash
from concord.llm.token_counts import op4_token_counts
from concord.llm.topk import OP5_SQL, op5_topk
from concord.llm.toxicity import op9_toxicity
from concord.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_topk": op5_topk,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_negatives": op12_negatives,
    "op13_jaccard": op13_jaccard,
}

ORACLES: dict[str, str] = {"op5_topk": OP5_SQL, "op8_warc": OP8_SQL, "op11_collocations": OP11_SQL, "op12_negatives": OP12_SQL, "op13_jaccard": OP13_SQL}
