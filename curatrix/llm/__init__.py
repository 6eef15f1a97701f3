"""Operators of a training-data pipeline: cleaning, deduplication, mixing, encoding and search.

Nothing else in the library imports this subpackage.  ``curatrix.llm.queries``
holds the registered queries and their SQL.
"""
