"""Operators for preparing training text at cluster scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
