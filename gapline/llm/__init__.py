"""Training-data operators: cleaning, de-duplication, mixing and archiving of web-scale text."""
