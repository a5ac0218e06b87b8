"""Operators for preparing training corpora of language models."""
