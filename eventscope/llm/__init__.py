"""Operators for preparing text corpora at scale.

Ten operators, each in a module of its own, plus ``queries`` that registers them.  Nothing
outside this subpackage (and ``corpus_pipeline.py``) imports from it.
"""
