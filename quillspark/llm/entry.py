"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op6_neighbours
from .extraction import op9_extraction
from .licenses import op2_licenses
from .mixing import ORACLE_SQL as _MIX
from .mixing import op4_mixing
from .neardup import ORACLE_SQL as _VECTORS
from .neardup import op3_neardup
from .packing import op1_packing
from .quality import op5_quality
from .setjoin import ORACLE_SQL as _JACCARD
from .setjoin import op7_jaccard
from .sharding import op10_sharding
from .urlfilter import ORACLE_SQL as _URLS
from .urlfilter import op8_urls

QUERIES = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_neardup": op3_neardup,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_neighbours": op6_neighbours,
    "op7_jaccard": op7_jaccard,
    "op8_urls": op8_urls,
    "op9_extraction": op9_extraction,
    "op10_sharding": op10_sharding,
}

ORACLE = {"op3_neardup": _VECTORS, "op4_mixing": _MIX, "op7_jaccard": _JACCARD, "op8_urls": _URLS}
