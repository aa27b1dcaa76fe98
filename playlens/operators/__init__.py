"""DataFrame -> DataFrame operators of the cleaning chain."""
