"""DataFrame operators over change logs and documents."""
