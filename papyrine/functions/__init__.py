"""Column functions: cleaning, text analysis, similarity, page parsing."""
