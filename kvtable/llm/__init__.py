"""Training-data operators.  Nothing outside this subpackage imports it.

Every operator takes a DataFrame with an identifier and a text column (named
by parameters), ignores or carries other columns, and gives NULL texts,
empty texts, repeated rows and empty tables a defined result that its
docstring states.
"""
