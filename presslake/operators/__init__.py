"""presslake subpackage."""
