"""Daily price panels, walk-forward forecasts and their scoring, as Spark DataFrame operators.

Every operator takes DataFrames and parameters and returns a DataFrame; nothing is computed
until an action runs.  See README.md for the map from operators to modules.
"""
