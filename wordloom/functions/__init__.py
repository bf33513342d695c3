"""Column functions: tokenizing, folding, similarities."""
