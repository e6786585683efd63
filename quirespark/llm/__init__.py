"""Training-data operators: web archives, media columns, packing, scoring, deduplication, encoding, rules and licences.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; what a null, an empty text,
a repeated row or an empty table gives is stated in the operator's docstring.
"""
