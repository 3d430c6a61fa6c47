"""Column helpers, frames, recurrences and joins shared by the operators."""
