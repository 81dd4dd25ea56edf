"""Operators that prepare text corpora for model training. Nothing outside imports this package."""
