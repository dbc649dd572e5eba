"""Rows that every operator must take."""

#: Null id, null and empty texts, ties, repeated rows, a very long text.
ODD = [(3, "b a"), (1, "a  b"), (2, "a\tb"), (2, "a\tb"), (5, None), (4, ""), (None, "a b"), (6, "word " * 60_000), (7, "é\n\n日本 ")]
