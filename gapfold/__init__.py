"""gapfold: terrestrial-laser-scan canopy analytics on Spark DataFrames."""

__version__ = "0.1.0"
