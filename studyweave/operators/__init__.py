"""DataFrame to DataFrame steps of the cohort build and the model."""
