"""Operators for building language-model training corpora.

Nothing else in the package imports this subpackage.  ``registry.QUERIES`` and ``registry.ORACLE_SQL`` hold the
``opN_<name>`` queries.
"""
