"""Item lifecycle as a stateful stream, an addition of this library."""
