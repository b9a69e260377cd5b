"""Ways to choose the grams that become index keys: each returns ``(gram, df)``."""
