"""Training-data operators: dedup, extraction, packing, privacy, toxicity, decontamination, language id, chat, quality."""
