"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` hold what ``__spark_entry__`` registers.
"""
