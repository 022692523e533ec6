"""Curve analytics and calibration on Spark DataFrames."""
