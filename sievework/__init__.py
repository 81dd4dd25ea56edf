"""Feature, split and evaluation jobs for supervised screening tables on Spark."""
