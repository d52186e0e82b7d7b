"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` in
``tidelog.llm.catalogue`` is the only door to it.
"""
