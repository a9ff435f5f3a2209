"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the
repository top and the registry in ``lexigrade.llm.catalog`` are its users.
"""
