"""Ontology-aware knowledge-graph analytics and corpus preparation on Spark DataFrames."""
