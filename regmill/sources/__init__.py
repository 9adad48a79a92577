"""Reading and writing pages, tables and logs."""
