"""Operators over trips DataFrames.

Every analytical operator takes a ``trips`` DataFrame (row level, or the
hourly roll-up: all of them are sums, so both give the same answer) and
returns a lazy DataFrame. Nothing is collected; row order is a presentation
concern and only used where it selects rows (top-k).
"""

P = "number_of_passenger"
PASSAGE = "number_of_passage"
