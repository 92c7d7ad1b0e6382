"""Queries of this subpackage and the SQL that says the same, where there is any."""

from loomgraph.llm.decontamination import OP4_SQL, op4_winnow_decontaminate
from loomgraph.llm.jaccard import OP10_SQL, op10_divideskip_jaccard
from loomgraph.llm.language import op6_zstd_language
from loomgraph.llm.lattice import op9_lattice_lm
from loomgraph.llm.mixing import op3_pfair_mix
from loomgraph.llm.quality import op1_byte_cnn_quality
from loomgraph.llm.sharding import op5_shard_ring
from loomgraph.llm.tokens import op7_separator_scan
from loomgraph.llm.topk import OP2_SQL, op2_dual_tree_topk
from loomgraph.llm.warc import OP8_SQL, op8_warc_revisit

QUERIES = {f.__name__: f for f in (op1_byte_cnn_quality, op2_dual_tree_topk, op3_pfair_mix, op4_winnow_decontaminate, op5_shard_ring, op6_zstd_language, op7_separator_scan, op8_warc_revisit, op9_lattice_lm, op10_divideskip_jaccard)}
ORACLE_SQL = {"op2_dual_tree_topk": OP2_SQL, "op4_winnow_decontaminate": OP4_SQL, "op8_warc_revisit": OP8_SQL, "op10_divideskip_jaccard": OP10_SQL}
