"""Training-data operators: scoring, deduplication, mixing, filtering and multimodal columns.

Nothing outside this subpackage imports it; ``queries`` lists the queries it registers.
"""
