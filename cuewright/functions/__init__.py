"""Part of cuewright."""
