"""watchline: event-intelligence operators for PySpark."""
