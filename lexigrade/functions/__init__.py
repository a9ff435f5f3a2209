"""Column expressions: text statistics, tokens, identifiers and lexical predicates."""
