"""Evidence-graph analytics on Spark DataFrames.

Reports and tabular records become text/row units; units become typed mentions,
entities and evidence-carrying relationships; relationships become a case graph,
rankings and review leads.  Every operator takes and returns DataFrames (or
Columns) and leaves physical planning to Catalyst.
"""
