"""Training-data operators: deduplication, decontamination, classifiers, scoring, encoding.

Every module holds one operator with a general DataFrame interface; the
thin registered queries are in ``queries``.  Operators read the id and text
columns they are given and nothing else of a table, so extra columns, also
ones that share a name with a result column, never take part.
"""
