"""Runs put together from operators, and the plans that precede them."""
