"""Training-data operators: ten large-corpus components plus their registered queries.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
