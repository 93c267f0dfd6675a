"""Reading, canonical layouts, schemas and sinks."""
