"""Plans: the registered report catalog, views and the comparison boundary."""
