"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from .decontaminate import OP1_SQL, op1_decontaminate
from .fingerprint import op7_fingerprint
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .language_id import op9_language_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .packing import op6_pack
from .pipeline import run
from .quality import op10_quality
from .secret_scan import op4_secret_scan
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op8_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_pack": op6_pack,
    "op7_fingerprint": op7_fingerprint,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "pipeline": run,
}
ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
}
