"""Spark jobs for data mining: tables, models, clusters, images; and `llm` for training text."""
