"""Column functions: tokenizer, n-grams, dates, formats."""
