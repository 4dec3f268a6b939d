"""Queries of this subpackage, and SQL where it can express them."""

from .lines import OP4_SQL, op4_line_dedup
from .pages import op6_page_text
from .periods import op13_periodic_runs
from .personal import op12_personal_data
from .secrets import op3_secret_scan
from .shingles import op8_ngram_jaccard
from .suffixes import op1_suffix_dedup
from .tokens import op7_bpe_monoid, op9_packing
from .toxicity import op5_toxicity
from .variants import op11_spelling_variants
from .vectors import OP10_SQL, op2_nearest, op10_embedding_dedup

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_nearest, op3_secret_scan, op4_line_dedup, op5_toxicity, op6_page_text, op7_bpe_monoid, op8_ngram_jaccard, op9_packing, op10_embedding_dedup, op11_spelling_variants, op12_personal_data, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op10_embedding_dedup": OP10_SQL}
