"""Query monitoring as a stream."""
