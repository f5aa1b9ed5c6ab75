"""Registered queries by subject, next to those of ``factloom.registry``; each has its SQL beside it."""
