"""A training corpus from raw documents: quality, exact and near duplicates, benchmark passages, tokens. The stages are in ``siltworks.llm.stages``."""

from siltworks.llm.stages import ORACLE_SQL, STAGES, good_quality, run, tokens, without_benchmarks, without_copies, without_near_copies

__all__ = ["ORACLE_SQL", "STAGES", "good_quality", "run", "tokens", "without_benchmarks", "without_copies", "without_near_copies"]
