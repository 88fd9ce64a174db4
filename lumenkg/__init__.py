"""lumenkg: a Spark-first engine for course-knowledge graphs and the text around them."""
