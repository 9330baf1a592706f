"""The queries of this subpackage and, where SQL can express one, its SQL."""

from .embeddings import op7_embeddings
from .language import op6_language
from .linededup import OP4_SQL, op4_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .packing import op8_packing
from .search import OP2_SQL, op2_bm25
from .secrets import op3_secrets
from .simhash import op10_simhash
from .suffixdedup import op1_suffix_dedup
from .tokenstore import op5_token_store

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_bm25": op2_bm25, "op3_secrets": op3_secrets, "op4_line_dedup": op4_line_dedup, "op5_token_store": op5_token_store, "op6_language": op6_language, "op7_embeddings": op7_embeddings, "op8_packing": op8_packing, "op9_mixing": op9_mixing, "op10_simhash": op10_simhash}
SQL = {"op2_bm25": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_mixing": OP9_SQL}
