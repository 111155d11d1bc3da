"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from tessera.llm.bit_sliced import OP8_SQL, op8_bit_sliced_topk
from tessera.llm.chat import OP4_SQL, op4_chat_formatting
from tessera.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tessera.llm.itemsets import OP12_SQL, op12_itemsets
from tessera.llm.licenses import OP11_SQL, op11_licenses
from tessera.llm.mixing import OP6_SQL, op6_mixing
from tessera.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from tessera.llm.phrases import OP13_SQL, op13_phrases
from tessera.llm.pieces import op9_sentencepiece
from tessera.llm.quality import op10_quality_qda
from tessera.llm.secrets import OP5_SQL, op5_secret_scans
from tessera.llm.token_files import op2_token_id_output
from tessera.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_id_output": op2_token_id_output,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_secret_scans": op5_secret_scans,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_bit_sliced_topk": op8_bit_sliced_topk,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_qda": op10_quality_qda,
    "op11_licenses": op11_licenses,
    "op12_itemsets": op12_itemsets,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op5_secret_scans": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_bit_sliced_topk": OP8_SQL,
    "op11_licenses": OP11_SQL,
    "op12_itemsets": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
