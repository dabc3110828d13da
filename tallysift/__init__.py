"""tallysift: detection-fusion analytics and data-quality operators as plain PySpark DataFrames."""

__version__ = "0.1.0"
