"""treeline: file-inventory analytics on Spark DataFrames.

A file tree or object-store listing is a table of file records. Every operator
takes and returns DataFrames; changes to the tree are plan tables plus pure
transforms of an inventory snapshot.
"""
