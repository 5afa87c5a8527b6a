"""Operators for preparing language-model training text.

Nothing outside this folder imports it.  Every operator takes a DataFrame whose
id and text columns can be named, ignores other columns, reads a null text as
the empty text (each docstring gives the result), and keeps one output row per
input row, repeated rows included, unless it says otherwise.
"""
