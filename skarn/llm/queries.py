"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .archive import OP9_SQL, op9_arc_to_warc
from .brown import op1_brown_classes
from .dropout import op4_merge_dropout
from .html import op3_site_templates
from .linededup import OP8_SQL, op8_reversible_lines
from .neardup import op6_bottom_k_near_dups
from .packing import op5_vector_packing
from .planes import op10_plane_files
from .quality import op2_robust_outliers
from .topk import OP7_SQL, op7_block_bounds

QUERIES = {f.__name__: f for f in (op1_brown_classes, op2_robust_outliers, op3_site_templates, op4_merge_dropout, op5_vector_packing, op6_bottom_k_near_dups, op7_block_bounds, op8_reversible_lines, op9_arc_to_warc, op10_plane_files)}

ORACLE_SQL: dict[str, str] = {"op7_block_bounds": OP7_SQL, "op8_reversible_lines": OP8_SQL, "op9_arc_to_warc": OP9_SQL}
