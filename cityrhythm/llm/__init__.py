"""Operators of a training-data pipeline over documents, vectors and web pages.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
