"""Operators for preparing language-model training data at scale.

Every operator takes and returns DataFrames and has its own general interface;
``queries`` holds the thin digest queries registered by the entry module.
Nothing outside this subpackage imports it.
"""
