"""Sightline: DataFrame operators over camera-sighting tables."""
