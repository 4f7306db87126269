"""Training-data operators: packing, similarity joins, filters, scans, mixing."""
