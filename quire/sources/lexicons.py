"""Lexicon parameters of the test fixtures.

Operators take lexicons as Python lists (small, literal) or as DataFrames
(any size); these are the inline values the fixture queries use.
"""

# ---------------------------------------------------------------- fixed values
COLORS = ["red", "blue", "black"]
BRANDS = ["ring", "gizmo", "bolt"]
STOP_WORDS = ["the", "and", "of", "in", "is"]
RANKED_TERMS = ["er", "the", "in", "on"]
# "known words" for lexicon coverage: tokens seen at least this often in D
KNOWN_WORD_MIN_COUNT = 5
