"""Operators for building training corpora, each a plain function over DataFrames.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
