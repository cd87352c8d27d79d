"""Operators for preparing training text. Nothing else in the package imports this folder."""
