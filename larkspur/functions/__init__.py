"""Column functions: trading calendar, texts of retrieval, exact quantiles of large groups."""
