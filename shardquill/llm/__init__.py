"""Operators for preparing large text collections; nothing else in this library imports them."""
