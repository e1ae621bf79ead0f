"""Training-data operators: fingerprints, filters, dedup, tokenization, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each
operator is a module of its own; ``queries.py`` registers them.
"""
