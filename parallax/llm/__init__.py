"""Training-data operators: decontamination, toxicity, packing, tool calls, media, licences, language, PII, dedup.

Nothing else in the library imports this subpackage.
"""
