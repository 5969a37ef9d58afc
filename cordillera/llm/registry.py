"""The queries of this subpackage, and the SQL of those that SQL can express."""

from .fingerprints import fingerprints_query
from .mixing import mix_query
from .neardup import near_duplicates_query
from .neighbors import neighbors_query
from .packing import pack_query
from .quality import quality_query
from .secrets import secrets_query
from .substrings import repeats_query
from .toxicity import toxicity_query
from .warc import REVISITS_SQL, revisits_query

QUERIES = {
    "op1_packing": pack_query,
    "op2_warc_revisits": revisits_query,
    "op3_fingerprints": fingerprints_query,
    "op4_repeats": repeats_query,
    "op5_quality": quality_query,
    "op6_secrets": secrets_query,
    "op7_mixing": mix_query,
    "op8_neighbors": neighbors_query,
    "op9_toxicity": toxicity_query,
    "op10_near_duplicates": near_duplicates_query,
}
ORACLE_SQL = {"op2_warc_revisits": REVISITS_SQL}
