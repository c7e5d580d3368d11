"""Grounded retrieval and knowledge-graph analytics as Spark plans."""
