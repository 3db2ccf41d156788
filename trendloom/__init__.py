"""Trendloom: themes, trends and signals from large text collections, on Spark.

Every operator takes DataFrames and returns DataFrames.  Parameters are checked
when the plan is built; nothing reads the clock ("now" is always an argument).
"""
