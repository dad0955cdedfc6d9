"""The queries of this subpackage and their SQL."""

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op10_language_id
from .licenses import op3_license_scan
from .line_dedup import op4_line_dedup
from .mixing import OP8_SQL, op8_mix_sources
from .near_dedup import op7_near_dedup
from .packing import op6_pack
from .quality_classifier import op5_quality_classifier
from .quality_rules import op1_quality_rules
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pack": op6_pack,
    "op7_near_dedup": op7_near_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op8_mix_sources": OP8_SQL, "op9_warc": OP9_SQL}
