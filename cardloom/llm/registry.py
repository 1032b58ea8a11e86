"""The numbered operator queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package that defines it
_WHERE = {
    "op1_substring_dedup": "substring_dedup",
    "op2_suffix_array_dedup": "suffix_dedup",
    "op3_packing": "packing",
    "op4_simhash": "simhash",
    "op5_pii": "pii",
    "op6_quality_rules": "quality",
    "op7_embedding_dedup": "embedding_dedup",
    "op8_sentencepiece": "sentencepiece_lattice",
    "op9_url_filters": "url_filters",
    "op10_lm_scoring": "lm_scoring",
    "op11_periodic_runs": "periodic_runs",
    "op12_tokenizer_alignment": "tokenizer_alignment",
    "op13_quality_classifier": "quality_classifier",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _WHERE.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}
