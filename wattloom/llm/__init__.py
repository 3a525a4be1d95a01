"""Operators for preparing training data. Nothing outside this package imports it.

Every operator takes the columns it needs by exact name and ignores all others, so
extra columns never clash with its own. Large steps are cut by tables written into
the folder that ``spark.checkpoint.dir`` names.
"""
