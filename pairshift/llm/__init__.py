"""Training-data operators: deduplication, quality, privacy, licences, tokens, packing, URL rules.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
