"""Planning of exports from metadata alone."""
