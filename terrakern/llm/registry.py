"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from terrakern.llm import checks, oracles
from terrakern.llm.chat import op13_chat
from terrakern.llm.decontaminate import op10_decontamination
from terrakern.llm.jaccard import op8_jaccard
from terrakern.llm.lm import op9_lm
from terrakern.llm.mixing import op3_mixing
from terrakern.llm.neardup import op7_neardup
from terrakern.llm.periodic import op12_runs
from terrakern.llm.pii import op5_pii
from terrakern.llm.quality import op6_quality
from terrakern.llm.secrets import op2_secrets
from terrakern.llm.sharding import op4_sharding
from terrakern.llm.trie import op11_trie
from terrakern.llm.urls import op1_urls

QUERIES = {
    "op1_urls": op1_urls,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_neardup": op7_neardup,
    "op8_jaccard": op8_jaccard,
    "op9_lm": op9_lm,
    "op10_decontamination": op10_decontamination,
    "op11_trie": op11_trie,
    "op12_runs": op12_runs,
    "op13_chat": op13_chat,
    **checks.QUERIES,
}

#: Most operators' own results are learned, hashed or searched for; parts that SQL can say are queries of their own.
ORACLE_SQL: dict[str, str] = {**oracles.ORACLE_SQL, **checks.ORACLE_SQL}
