"""Sources: CSV / JSON files (SRC-1/2/3/5/9) and catalog inputs (SRC-4/6/7/11)."""
