"""Feature groups, profiles, classification, evaluation, drift and corpus preparation."""
