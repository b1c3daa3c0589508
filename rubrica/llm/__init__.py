"""Operators for building training data: one module each, with their queries in ``queries``."""
