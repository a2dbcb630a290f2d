"""quern: a Spark-first engine for single-table analytics and corpus preparation."""
