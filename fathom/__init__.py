"""Effect-report analytics and corpus operators on Spark DataFrames."""
