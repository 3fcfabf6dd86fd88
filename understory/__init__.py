"""Field-survey and canopy-structure analytics on Spark DataFrames."""
