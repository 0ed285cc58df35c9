"""Training-data operators: filtering, near-duplicate removal, decontamination, tokenising, scoring."""
