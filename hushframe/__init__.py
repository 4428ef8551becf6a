"""hushframe: detection and removal of personal data in texts and page layouts, on Spark DataFrames."""

__version__ = "0.1.0"
