"""Training-data operators: language id, LM scoring, deduplication, decontamination, PII, search and mixing."""
