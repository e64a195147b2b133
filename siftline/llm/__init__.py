"""Training-data operators: one module per operator, queries in :mod:`siftline.llm.queries`.

Nothing outside this subpackage imports it.
"""
