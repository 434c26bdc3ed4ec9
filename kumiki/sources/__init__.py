"""Sources of the lattice tokenizer."""
