"""Tables, landed records, reference data and sinks."""
