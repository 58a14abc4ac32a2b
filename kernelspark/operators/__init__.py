"""DataFrame operators: rows, joins, aggregates, sampling, linear algebra, SVM, kernels."""
