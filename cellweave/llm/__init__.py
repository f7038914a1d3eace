"""Training-data operators: ten text and vector operators and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
