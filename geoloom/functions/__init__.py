"""Part of the geoloom engine."""
