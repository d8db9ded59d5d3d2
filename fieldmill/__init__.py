"""fieldmill: listings, pages and texts to clean, searchable, measurable tables, as lazy Spark plans."""
