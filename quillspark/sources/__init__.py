"""Sources and sinks: loads, exports, temporary tables, copies, and partition listings."""
