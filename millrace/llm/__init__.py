"""Training-data operators at corpus scale.

Nothing else in the library imports this subpackage.  Every operator is a function
from DataFrames to a DataFrame; ``queries`` binds them to the test tables.
"""
