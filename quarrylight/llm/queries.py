"""The registered corpus queries and, where SQL can express them, their SQL."""

from quarrylight.llm import decontam, jaccard, licenses, lines, negatives, packing, quality, simhash, substrings, toxicity, trie, urls, warc

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_warc": warc.op2_warc,
    "op3_licenses": licenses.op3_licenses,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_jaccard_join": jaccard.op13_jaccard_join,
}
ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op8_substring_dedup": substrings.OP8_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_jaccard_join": jaccard.OP13_SQL,
}
