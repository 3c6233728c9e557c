"""panelforge: panel time-series analytics and corpus preparation as Spark jobs."""
