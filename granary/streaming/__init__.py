"""No query of this engine keeps streaming state.

Filters, projections and semi-joins with a static side are row-local, so the functions of
``granary.operators`` take a streaming DataFrame as they take a batch one.
"""
