"""Operators for large training corpora: dealt methods, their queries and checking SQL."""
