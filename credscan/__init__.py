"""Finding and scoring exposed credentials in tables of text, on Spark."""
