"""Train of the lattice tokenizer."""
