"""Column functions: pair scores, classification, language detection, text and paths."""
