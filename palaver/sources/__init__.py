"""Where events come from and where results go."""
