"""The registered queries of the training-data operators."""

from __future__ import annotations

import importlib

#: Query name -> module of this package; the function has the query's name.
MODULES = {
    "op1_sharding": "sharding",
    "op2_language_id": "langid",
    "op3_license_scan": "licenses",
    "op4_simhash_dedup": "simhash_dedup",
    "op5_toxicity": "toxicity",
    "op6_mixing": "mixing",
    "op7_quality_model": "quality_model",
    "op8_fingerprints": "fingerprints",
    "op9_packing": "packing",
    "op10_quality_rules": "quality_rules",
    "op11_jaccard_join": "jaccard_join",
    "op12_periodic_runs": "runs",
    "op13_merkle_manifest": "merkle",
}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"kgspark.llm.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from kgspark.llm import merkle

    return {"op13_merkle_manifest": merkle.SQL}
