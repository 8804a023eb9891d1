"""Multi-tenant sales analytics on order headers and order lines, on Spark.

Every operator is a function from DataFrames to a DataFrame.  See README.md.
"""
