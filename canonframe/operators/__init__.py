"""DataFrame -> DataFrame operators over addressed corpora."""
