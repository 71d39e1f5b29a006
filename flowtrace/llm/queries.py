"""The subpackage's registered queries."""

from flowtrace.llm.alignment import op13_alignment
from flowtrace.llm.byte_bpe import op5_byte_bpe
from flowtrace.llm.decontamination import op7_decontamination
from flowtrace.llm.jaccard_join import op3_jaccard_join
from flowtrace.llm.neighbours import op2_neighbours
from flowtrace.llm.oracle import ORACLE_SQL  # noqa: F401  (registered with the queries)
from flowtrace.llm.packing import op11_packing
from flowtrace.llm.phrase_dedup import op9_phrase_dedup
from flowtrace.llm.pii import op6_pii
from flowtrace.llm.quality import op8_quality
from flowtrace.llm.runs import op12_runs
from flowtrace.llm.suffix_dedup import op4_suffix_dedup
from flowtrace.llm.token_store import op10_token_store
from flowtrace.llm.warc import op1_warc

QUERIES = {f.__name__: f for f in (
    op1_warc, op2_neighbours, op3_jaccard_join, op4_suffix_dedup, op5_byte_bpe, op6_pii, op7_decontamination, op8_quality,
    op9_phrase_dedup, op10_token_store, op11_packing, op12_runs, op13_alignment,
)}
