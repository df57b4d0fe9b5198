"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import conversation_trie, hard_negatives, line_dedup, url_filter, warc
from .chat import op5_chat
from .conversation_trie import op12_conversation_trie
from .decontam import op6_decontam
from .fingerprint import op3_fingerprint
from .hard_negatives import op11_hard_negatives
from .jaccard import op8_jaccard
from .langid import op4_langid
from .line_dedup import op1_line_dedup
from .packing import op2_packing
from .rans import op9_rans
from .sharding import op10_sharding
from .url_filter import op13_url_filter
from .warc import op7_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_fingerprint": op3_fingerprint,
    "op4_langid": op4_langid,
    "op5_chat": op5_chat,
    "op6_decontam": op6_decontam,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_rans": op9_rans,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op7_warc": warc.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_url_filter": url_filter.SQL,
}
