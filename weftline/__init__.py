"""Graph, search and set analytics over tables of software symbols, on Spark DataFrames."""
