"""Scalar functions: every function takes and returns ``Column``."""
