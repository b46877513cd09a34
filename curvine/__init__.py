"""DataFrame operators for curating and analysing embedding-centric data on Spark."""
