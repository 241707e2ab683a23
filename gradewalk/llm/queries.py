"""The queries of this folder by name, with their SQL where SQL can express them."""

from __future__ import annotations

from gradewalk.llm import jaccard, lines, media, mixing, negatives, neighbours, packing, phrases, quality, secrets, toxicity, urls, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc_round_trip": warc.op2_warc_round_trip,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_media_transport_streams": media.op4_media_transport_streams,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_toxicity_chain": toxicity.op7_toxicity_chain,
    "op8_url_filters": urls.op8_url_filters,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_quality_neighbours": neighbours.op13_quality_neighbours,
    "quality_ablations": quality.quality_ablations,
}

ORACLES = {
    "op2_warc_round_trip": warc.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "quality_ablations": quality.ABLATIONS,
}
