"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import alignment, decontaminate, lm_score, neighbours, packing, repeats, secrets, sharding, simhash, spotsigs, toxicity, variants, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_secrets": secrets.op6_secrets,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_simhash": simhash.op9_simhash,
    "op10_sharding": sharding.op10_sharding,
    "op11_variants": variants.op11_variants,
    "op12_alignment": alignment.op12_alignment,
    "op13_neighbours": neighbours.op13_neighbours,
}
SQL = {"op1_warc": warc.OP1_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op7_suffix_dedup": repeats.OP7_SQL, "op8_lm_score": lm_score.OP8_SQL, "op13_neighbours": neighbours.OP13_SQL}
