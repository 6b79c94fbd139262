"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontam import OP5_SQL, op5_decontamination
from .langid import op9_langid
from .ngram_lm import op1_ngram_trie
from .packing import op10_bm25_packing
from .pfor import op3_pfor_ids
from .secrets import op8_secret_forest
from .sharding import op4_minimax_shards
from .simhash import op7_simhash
from .tiff import op2_tiff_pages
from .urlfilter import OP6_SQL, op6_url_rules


def queries() -> dict:
    return {
        "op1_ngram_trie": op1_ngram_trie,
        "op2_tiff_pages": op2_tiff_pages,
        "op3_pfor_ids": op3_pfor_ids,
        "op4_minimax_shards": op4_minimax_shards,
        "op5_decontamination": op5_decontamination,
        "op6_url_rules": op6_url_rules,
        "op7_simhash": op7_simhash,
        "op8_secret_forest": op8_secret_forest,
        "op9_langid": op9_langid,
        "op10_bm25_packing": op10_bm25_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op6_url_rules": OP6_SQL}
