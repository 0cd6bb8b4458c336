"""Operators on DataFrames of documents, mentions, predictions and date graphs."""
