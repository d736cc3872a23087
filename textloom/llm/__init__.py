"""Operators for preparing text corpora for language-model training.

One module per operator (general interface, real outputs), ``contracts`` with
the thin per-table queries, and ``shared`` / ``kernels`` with what they share.
Nothing else in the package imports this subpackage.
"""
