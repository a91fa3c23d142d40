"""pointsmith: vector, text and hybrid retrieval over DataFrames of points."""
