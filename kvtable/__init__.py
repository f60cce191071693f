"""kvtable: a versioned key-value table and its query operators on stock Spark."""
