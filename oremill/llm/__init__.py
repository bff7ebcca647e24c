"""Operators for preparing training text: ten jobs on documents and embeddings.

Nothing outside this folder imports it; ``queries.py`` lists the registered
queries and their SQL.
"""
