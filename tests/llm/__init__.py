"""Tests of the corpus operators."""
