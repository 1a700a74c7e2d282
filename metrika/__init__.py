"""metrika: metrical and phonological analytics on Spark DataFrames."""
