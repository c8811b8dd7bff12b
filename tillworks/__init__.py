"""Product-sales quality and analytics on Spark.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing here holds rows in
Python.  See README.md for the map from operator to module.
"""

from tillworks.config import Config

__all__ = ["Config"]
