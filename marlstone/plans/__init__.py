"""Plan-level helpers: session settings and lineage cuts."""
