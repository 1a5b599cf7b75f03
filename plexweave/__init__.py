"""Single-cell read processing, and data preparation, as DataFrame plans."""
