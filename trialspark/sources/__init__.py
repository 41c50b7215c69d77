"""Reading measurement exports and subject tables, writing result series."""
