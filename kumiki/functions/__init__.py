"""Functions of the lattice tokenizer."""
