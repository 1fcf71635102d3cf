"""Point-in-time research data on Spark.

Every operator is a function from DataFrames to DataFrames; nothing is collected to the driver.  See README.md.
"""
