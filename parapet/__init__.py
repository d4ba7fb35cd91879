"""Building-stock analytics as Spark DataFrame operators.

``sources``    reading, column naming and writing
``functions``  column expressions (numbers, text, bands, votes, sample keys)
``operators``  DataFrame -> DataFrame building blocks
``plans``      the chains and report documents made of them
"""
