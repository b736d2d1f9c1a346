"""Link change detection over page snapshots, written for Spark."""

__version__ = "0.1.0"
