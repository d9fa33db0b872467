"""Training-data operators: deduplication, scoring, tokenisation, filtering and formatting of text corpora."""
