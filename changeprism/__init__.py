"""Change-history analytics on Spark: change risk from commits, issues, pull requests and incidents."""

__version__ = "0.1.0"
