"""Operators over comments and prose: extraction, metrics, scores, reports."""
