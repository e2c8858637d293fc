"""Whole passes put together from the operators."""
