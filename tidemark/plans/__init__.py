"""Evaluation plans: clustering, summary and question metrics as aggregations."""
