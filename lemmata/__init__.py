"""Proof-carrying reasoning and analytics over (subject, predicate, object) facts, on Spark DataFrames."""
