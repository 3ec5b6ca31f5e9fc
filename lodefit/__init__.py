"""lodefit: likelihood fitting and error analysis over Spark DataFrames."""
