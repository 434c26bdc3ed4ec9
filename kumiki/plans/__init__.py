"""Plans of the lattice tokenizer."""
