"""ferryline: moving, checking and analysing tables at scale with PySpark."""
