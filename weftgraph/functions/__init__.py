"""weftgraph subpackage."""
