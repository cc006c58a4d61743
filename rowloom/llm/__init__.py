"""Training-data operators: dedup, scans, language models, tokenising."""
