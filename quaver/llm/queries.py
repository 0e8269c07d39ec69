"""The queries of this subpackage, each over its whole table with the operator's production parameters."""

from quaver.llm import ann, language, lines, merkle, mixing, packing, simhash, suffixes, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_simhash": simhash.query,
    "op3_mixing": mixing.query,
    "op4_nearest": ann.query,
    "op5_language": language.query,
    "op6_merkle": merkle.query,
    "op7_packing": packing.query,
    "op8_suffixes": suffixes.query,
    "op9_urls": urls.query,
    "op10_lines": lines.query,
}

#: None of these is expressible in DuckDB's SQL: they rest on trained models, 64-bit XXH64 or byte-pair encoding.
#: tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {}
