"""rewardloom: text-to-SQL training-data tables on Spark.

Everything here is a function ``DataFrame -> DataFrame`` or ``Column -> Column``
built from the DataFrame API and Spark SQL functions. Subpackages:

* ``functions``  column expressions (prompt text, SQL extraction, validation,
  difficulty, token counts, error classes, reward arithmetic)
* ``operators``  table operators (preference pairs, result-set comparison,
  rewards, rollout statistics, evaluation metrics, token tables, schema text,
  guarded query runs, ordinals)
* ``sources``    readers and writers (JSON, JSONL, one-document JSON, views)
* ``plans``      bindings from the driver's parquet tables to the operators'
  inputs, and the registered queries
* ``streaming``  the same per-row operators over a file stream
"""

from rewardloom.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
