"""Operators for building training corpora, each a plain function over DataFrames."""
