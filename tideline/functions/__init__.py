"""Column functions: coercions over VARIANT values, timestamps, durations."""
