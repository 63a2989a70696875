"""Training-data operators: deduplication, decontamination, extraction, encoding, search and filtering."""
