"""Training-data operators: filtering, deduplication, tokens, packing, search.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
