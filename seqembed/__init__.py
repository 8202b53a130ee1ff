"""Stage, tokenize, embed, pool, index and check sequence and cell data with Spark DataFrames."""
