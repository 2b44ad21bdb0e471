"""Files and documents as tables."""
