"""Document retrieval on Spark: chunking, term statistics, BM25 and hybrid ranking, and budgeted excerpts as DataFrames."""
