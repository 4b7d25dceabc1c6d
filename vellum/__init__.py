"""Document-conformance and retrieval analytics on Spark DataFrames.

Operators are functions of DataFrames keyed by doc_id, with an explicit ordinal wherever order matters.
"""
