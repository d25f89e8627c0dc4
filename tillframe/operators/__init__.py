"""Operators: each is ``f(df, ..., params) -> DataFrame``."""
