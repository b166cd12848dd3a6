"""Operators for training-data pipelines: filtering, dedup, scanning, encoding.

Each module holds one operator as DataFrame -> DataFrame functions with their
own parameters; ``queries`` registers one query per operator over the driver
tables.  Nothing else in the library imports this subpackage.
"""
