"""Jobs made of several operators: load, export."""
