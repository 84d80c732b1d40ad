"""No streams: the operators are batch operators, and the reference has none that are not."""
