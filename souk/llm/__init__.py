"""Corpus operators for training-data pipelines (one module per operator).

Nothing else in the package imports this subpackage; ``queries.py`` registers
one ``opN_<name>`` query per operator, which ``__spark_entry__`` adds when the
subpackage imports.
"""
