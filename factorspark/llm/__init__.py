"""Operators that prepare training text: one module per operator, each with its registered query."""
