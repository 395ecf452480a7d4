"""Reading documents, manual records, cells and words; writing results."""
