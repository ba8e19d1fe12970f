"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage (but ``corpus_pipeline.py``) imports it, so it can be left out.
"""
