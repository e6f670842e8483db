"""DataFrame operators: numbering, joins, flow rollup, rule checks and rendering."""
