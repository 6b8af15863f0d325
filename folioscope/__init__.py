"""Batch passage retrieval with page-level citations, as lazy DataFrame operators."""
