"""Product consolidation for fiscal records, as Spark DataFrame jobs.

Every operator takes and returns DataFrames and keeps the taxpayer id
(``cnpj``) in its keys, so one job serves all taxpayers at once.
"""
