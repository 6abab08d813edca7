"""Cloakwork: detection, resolution, pseudonymisation and audit of personal data in text corpora, on Spark."""
