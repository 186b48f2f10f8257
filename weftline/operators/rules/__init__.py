"""Rule tables and the scanners that apply them."""
