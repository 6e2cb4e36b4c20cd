"""Operators for preparing training corpora at scale.

Nothing outside this folder (except the registration guard in ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
