"""The library's operators as registered queries over the driver's tables."""
