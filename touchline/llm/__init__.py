"""Operators for large training-data pipelines over `documents`, `embeddings`, `conversations` and their relatives."""
