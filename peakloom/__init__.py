"""Dataset operators for nested spectroscopic peak lists on Spark DataFrames."""
