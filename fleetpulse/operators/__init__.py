"""DataFrame -> DataFrame operators of the screening and plot-data steps."""
