"""The queries of this subpackage and their SQL."""

from . import decontaminate, html_extract, lexical_search, license_scan, ngram_join, packing, quality_rules, sharding, source_mix, substring_dedup, token_alignment, token_output, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_source_mix": source_mix.query,
    "op3_html_extract": html_extract.query,
    "op4_token_output": token_output.query,
    "op5_decontaminate": decontaminate.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_sharding": sharding.query,
    "op8_license_scan": license_scan.query,
    "op9_url_filter": url_filter.query,
    "op10_quality_rules": quality_rules.query,
    "op11_packing": packing.query,
    "op12_token_alignment": token_alignment.query,
    "op13_lexical_search": lexical_search.query,
}
ORACLES: dict[str, str] = {"op1_ngram_join": ngram_join.SQL, "op3_html_extract": html_extract.SQL, "op7_sharding": sharding.SQL, "op9_url_filter": url_filter.SQL, "op10_quality_rules": quality_rules.SQL, "op13_lexical_search": lexical_search.SQL}
