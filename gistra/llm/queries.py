"""The queries of this subpackage and their SQL."""

from gistra.llm import fingerprints, media, mixing, ngram_join, packing, quality, secrets, toxicity, url_rules, warc

QUERIES = {
    "op1_url_filters": url_rules.query,
    "op2_toxicity": toxicity.query,
    "op3_media_columns": media.query,
    "op4_warc": warc.query,
    "op5_quality_classifier": quality.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_secret_scans": secrets.query,
    "op8_source_mixing": mixing.query,
    "op9_best_fit_packing": packing.query,
    "op10_document_fingerprints": fingerprints.query,
}
ORACLES = {"op1_url_filters": url_rules.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op6_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op8_source_mixing": mixing.ORACLE_SQL}
