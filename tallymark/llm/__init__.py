"""Training-data operators: scoring, scans, filters, de-duplication, packing and binary output."""
