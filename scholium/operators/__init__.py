"""DataFrame to DataFrame operators; all take column names as parameters."""
