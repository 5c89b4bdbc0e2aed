"""The queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from fixturelake.llm import oracles as _oracles
from fixturelake.llm.align import op11_alignment
from fixturelake.llm.jaccard import op10_jaccard
from fixturelake.llm.langid import op7_langid
from fixturelake.llm.lines import op12_lines
from fixturelake.llm.lm import op5_lm
from fixturelake.llm.merkle import op13_manifest
from fixturelake.llm.neardup import op1_neardup
from fixturelake.llm.packing import op4_packing
from fixturelake.llm.pieces import op3_pieces
from fixturelake.llm.quality import op8_quality
from fixturelake.llm.secrets import op9_secrets
from fixturelake.llm.sharding import op6_sharding
from fixturelake.llm.warc import op2_warc

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_warc": op2_warc,
    "op3_pieces": op3_pieces,
    "op4_packing": op4_packing,
    "op5_lm": op5_lm,
    "op6_sharding": op6_sharding,
    "op7_langid": op7_langid,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_jaccard": op10_jaccard,
    "op11_alignment": op11_alignment,
    "op12_lines": op12_lines,
    "op13_manifest": op13_manifest,
}
ORACLES = dict(_oracles.ORACLES)
