"""Operators of a training-data pipeline: duplicates, formatting, media, filters, packing, language models, quality, mixing.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
