"""kernelspark: distributed kernel SVM and tall-skinny linear algebra on
Spark DataFrames."""

__version__ = "0.1.0"
