"""Operators for training-data pipelines.

Nothing outside this package imports it, except the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
