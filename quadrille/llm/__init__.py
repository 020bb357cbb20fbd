"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage; its queries are listed in
``quadrille.llm.queries`` and picked up by ``__spark_entry__`` when present.
"""
