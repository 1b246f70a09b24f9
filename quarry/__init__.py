"""quarry: code-intelligence analytics as DataFrame-to-DataFrame operators on Spark."""
