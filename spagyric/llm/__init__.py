"""Operators for training text and for entity work; nothing else in the package imports this."""
