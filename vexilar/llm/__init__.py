"""Operators for preparing training data: ten operators over whole texts, each with its own query."""
