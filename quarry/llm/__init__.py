"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; ``queries`` registers its contract
queries and ``__spark_entry__`` adds them when the subpackage is present.
"""
