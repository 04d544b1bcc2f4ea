"""Sources and sinks: memory snapshots, event logs, exports, evaluation cases."""
