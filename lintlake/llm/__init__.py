"""Operators that prepare source code and documents as training data."""
