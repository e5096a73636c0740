"""Training-data operators: mixing, dedup, quality, safety, language and tokenizer stages.

Nothing else in the library imports this subpackage; its queries live in ``textloom.llm.registry``.
"""
