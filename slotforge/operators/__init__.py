"""Operators over tables of slots, tokens, decisions and truth; each takes and returns DataFrames."""
