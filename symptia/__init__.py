"""Symptom-text triage, knowledge retrieval and evaluation as Spark jobs."""
