"""newsloom: story analytics over news-like tables as plain Spark jobs."""
