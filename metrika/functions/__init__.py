"""metrika subpackage."""
