"""Operators of a training-data pipeline over a table of documents: near-duplicate joins, exact
repeat removal, quality and toxicity classifiers, secret scans, mixing, exact vector search and
BPE encoding. Nothing else in the library imports this subpackage."""
