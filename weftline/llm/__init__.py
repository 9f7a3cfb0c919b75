"""Operators for large training-data pipelines.

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded import
in ``__spark_entry__.py`` uses it.
"""
