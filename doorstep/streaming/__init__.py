"""Streaming forms of the rules over append-only tables; each equals its batch form."""
