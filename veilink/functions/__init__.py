"""Column expressions: keyed draws, bigrams, hash residues, packed words, damage rules."""
