"""Training-data operators: packing, dedup, quality, decontamination, sketches, chat, archives, scans.

Nothing outside this subpackage imports it. Every operator takes DataFrames, reads only the columns
it names (other columns may be there, under any name) and returns a DataFrame.
"""
