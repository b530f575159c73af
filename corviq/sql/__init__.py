"""The SQL dialect: tokens, a recursive-descent parser and a compiler to DataFrames."""
