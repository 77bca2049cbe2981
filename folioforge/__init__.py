"""folioforge: retrieval evaluation, curation and work-queue operators on Spark DataFrames."""

__version__ = "0.1.0"
