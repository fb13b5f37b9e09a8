"""Whole plans made of the operators, and the providers that feed them."""
