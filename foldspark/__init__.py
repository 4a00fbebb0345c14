"""A functional collection-and-reduction algebra expressed on PySpark DataFrames."""
