"""Training-data pipeline operators on Spark.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries.  Nothing else in the library imports
this subpackage.
"""
