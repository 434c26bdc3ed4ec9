"""Operators of the lattice tokenizer."""
