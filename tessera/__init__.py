"""tessera: Spark-native data work for a multi-tenant customer-conversation
service (records, dashboards, knowledge base search, reports, quality and
live streams), as functions that take and return DataFrames."""

__version__ = "0.1.0"
