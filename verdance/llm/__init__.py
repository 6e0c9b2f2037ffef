"""Training-data operators over text corpora.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own general interface; ``queries`` registers the thin queries.
"""
