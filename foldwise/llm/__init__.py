"""Operators for building language-model training data at scale.

One module per operator (general interface, real outputs) plus ``queries``,
which registers one query per operator over the corpus tables.  Nothing
outside this subpackage imports it.
"""
