"""Operators for training-data pipelines.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; :mod:`filigree.llm.queries` holds the thin registered
queries that bind them to the standard tables.
"""
