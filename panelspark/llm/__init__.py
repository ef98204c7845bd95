"""Training-data operators: tokenizers, joins, packing, scans, search and language models."""
