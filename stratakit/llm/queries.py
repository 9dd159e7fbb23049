"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from stratakit.llm.decontaminate import op6_decontaminate
from stratakit.llm.hmm import op2_hmm
from stratakit.llm.langid import op10_language
from stratakit.llm.linededup import OP9_SQL, op9_line_dedup
from stratakit.llm.lloyd import OP13_SQL, op13_centroids
from stratakit.llm.mixing import op8_mixing
from stratakit.llm.quality import op4_quality
from stratakit.llm.runs import op11_periodic_runs
from stratakit.llm.sharding import op3_sharding
from stratakit.llm.simhash import op5_simhash
from stratakit.llm.suffixes import op12_suffix_dedup
from stratakit.llm.tokens import op1_tokens
from stratakit.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_hmm": op2_hmm,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_language": op10_language,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op13_centroids": OP13_SQL,
}
