"""Operators for training-data pipelines, with their queries and the SQL that checks them."""
