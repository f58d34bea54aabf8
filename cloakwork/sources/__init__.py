"""Files in and out: formats become tables of text units, and rewritten units become files again."""
