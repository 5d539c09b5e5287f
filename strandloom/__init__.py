"""strandloom: sequence search, classification and reporting on Spark DataFrames."""
