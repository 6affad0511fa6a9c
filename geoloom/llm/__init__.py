"""Operators for preparing training data at scale; nothing else in this package imports them."""
