"""Trajectory analytics on PySpark: segments, interval joins and closed-form distances as DataFrames."""
