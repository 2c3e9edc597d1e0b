"""Operators for preparing text, vector and page collections for model training."""
