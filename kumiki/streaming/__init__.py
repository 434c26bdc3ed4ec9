"""Streaming of the lattice tokenizer."""
