"""DataFrame operators for mining typed networks and feature tables on Spark.

Every operator takes DataFrames and returns DataFrames.  Matrices are
coordinate tables ``(i, j, value)``; rows of features are ``array<double>``
or ``pyspark.ml`` vector columns.
"""

__version__ = "0.1.0"
