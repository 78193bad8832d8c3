"""Relational building blocks, each a function from DataFrame to DataFrame."""
