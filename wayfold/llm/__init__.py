"""Operators that prepare corpora for training language models.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
