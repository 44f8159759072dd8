"""Analytics on account, post and comment tables, as lazy PySpark plans."""
