"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and the module whose query(spark, sf_dir) it is; ORACLE there is its SQL.
MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_token_store": "token_store",
    "op3_toxicity": "toxicity",
    "op4_simhash_dedup": "simhash",
    "op5_warc": "warc",
    "op6_media": "media",
    "op7_chat": "chat",
    "op8_secrets": "secret_scan",
    "op9_token_counts": "wordpiece",
    "op10_mix": "mixing",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: _module(where).query for name, where in MODULES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict:
    return {name: sql for name, where in MODULES.items() if (sql := getattr(_module(where), "ORACLE", None))}
