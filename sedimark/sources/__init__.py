"""Readers that turn files and tables into the roles the operators take."""
