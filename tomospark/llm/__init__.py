"""Training-data operators: dedup, decontamination, language ID, mixing, token output.

Nothing outside this subpackage imports it.
"""
