"""panelfolio: portfolio time-series analytics as PySpark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame. Universes, assets, runs (strategy x parameter set x
scenario) and resampling replicates are partition keys, so thousands of runs go through one job.
"""
