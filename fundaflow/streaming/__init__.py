"""Structured Streaming forms of the ledger, ingest, model and decision steps.

The reference polls, without event time; late knowledge is carried by `available_at` in the
data, so no watermark drops rows.  Every sink writes a batch to its own `batch_id=N` folder:
a batch delivered again replaces its own output.
"""
