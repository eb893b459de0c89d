"""upkeep: maintenance-operations analytics as Spark DataFrame plans.

Every operator takes DataFrames (plus plain parameters) and returns a lazy
DataFrame.  Nothing is collected inside an operator; Catalyst and adaptive
query execution choose the physical plan.
"""

__version__ = "0.1.0"
