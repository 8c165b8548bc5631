"""Operators for building training data: tokenising, scoring, deduplicating and filtering text at scale."""
