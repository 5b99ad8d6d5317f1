"""Part of shelfspark; see the README for the map of the package."""
