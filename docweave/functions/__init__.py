"""Column expressions: text, embeddings, similarity and identifiers."""
