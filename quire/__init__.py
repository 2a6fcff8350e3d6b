"""quire: a page-assembly engine on Spark DataFrames."""
