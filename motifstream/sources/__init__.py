"""Where graphs come from: text files, DataFrames and the test tables."""
