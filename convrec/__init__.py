"""convrec: DataFrame operators for building conversational-recommendation data on Spark.

Every public operator takes DataFrames (plus column-name parameters) and
returns a DataFrame; the work is expressed with built-in Spark SQL
expressions, joins, aggregations and windows so Catalyst can plan it.
"""

__version__ = "0.1.0"
