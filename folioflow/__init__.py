"""Documents as relations: sources, unit operators, write-back sinks and checks on PySpark."""
