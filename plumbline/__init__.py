"""Column lineage, warehouse queries and corpus operators on Spark."""

VERSION = "0.2.0"
