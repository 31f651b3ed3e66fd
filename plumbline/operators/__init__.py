"""The parts of a query: select, filter, sort, nest, page and group."""
