"""Column functions: text cleaning, tokenizers, summaries, page markup, vectors."""
