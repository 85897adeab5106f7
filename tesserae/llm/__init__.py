"""Training-data operators: formatting, mixing, classifying, extraction, dedup, BPE, PII and LM scoring.

Nothing outside this subpackage imports it; ``registry`` holds its queries and SQL.
"""
