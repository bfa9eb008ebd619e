"""Reading, cleaning, upserting and writing bars and reports."""
