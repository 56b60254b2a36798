"""Operators for preparing training corpora, their registered queries and SQL twins.

Nothing outside this subpackage imports it.
"""
