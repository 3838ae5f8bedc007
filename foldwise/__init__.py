"""foldwise — labelled, grouped window analytics and evaluation on Spark."""

__version__ = "0.1.0"
