"""Analytics over document-heavy record data, as DataFrame and SQL plans for Spark."""
