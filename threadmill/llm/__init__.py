"""Training-data operators: tokenising, filtering, deduplication, sharding and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
