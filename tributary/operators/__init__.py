"""DataFrame to DataFrame operators, grouped by the stage they belong to."""
