"""marketlens: price-intelligence and corpus-preparation operators on PySpark."""
