"""meterlake: usage, attribution and capacity analytics as Spark DataFrame operators."""
