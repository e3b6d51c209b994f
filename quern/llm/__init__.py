"""Training-data operators: archives, dedup, scoring, mixing and tokenisation of text corpora."""
