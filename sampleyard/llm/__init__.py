"""Operators for preparing text corpora for language-model training.  Nothing outside imports this package."""
