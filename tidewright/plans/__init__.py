"""What happens to a statement before Spark plans it."""
