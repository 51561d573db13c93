"""Statements that arrive one after another."""
