"""Named queries over a data folder, each with the same query in SQL where SQL can express it."""
