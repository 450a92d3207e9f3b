"""Operators of a language-model data pipeline. Nothing outside this folder, `corpus_pipeline.py` and `tests/llm` imports it."""
