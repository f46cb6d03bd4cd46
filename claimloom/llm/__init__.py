"""Operators that turn a document corpus into language-model training data."""
