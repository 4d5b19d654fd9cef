"""The corpus pipeline, as the stages of palimpsest.llm.pipeline: quality, boilerplate lines, near duplicates, contamination
and packing. STAGES lists (name, function); run(spark, sf_dir) applies them to `documents`; ORACLE_SQL is None, as SQL can
express neither the tokenizer nor the packing. What each stage makes of nulls, empty and repeated rows, empty tables and
extra columns is told there."""

from palimpsest.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
