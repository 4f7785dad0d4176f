"""Corpus operators for training data: dedup, decontamination, toxicity, tokens, packing, chat formatting.

Nothing else in the library imports this subpackage. :mod:`tessera.llm.queries` registers one query per operator.
"""
