"""Training-data preparation: PII, packing, deduplication, quality, decontamination,
token counts and licence scans over document tables.

Every operator takes a DataFrame plus the names of its id and text columns, reads
only those two, and returns rows keyed by the id; other columns of the input never
clash with its own. ``queries`` holds the registered queries, ``oracle`` their SQL.
"""
