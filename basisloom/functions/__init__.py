"""Column builders: windows, calendar, prices and sizes."""
