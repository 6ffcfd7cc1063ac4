"""Corpus preparation on Spark: extract, clean, deduplicate, mix, chunk, tokenize, format and evaluate text."""
