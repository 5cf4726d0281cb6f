"""The row-wise part of the pipeline on a streaming source."""
