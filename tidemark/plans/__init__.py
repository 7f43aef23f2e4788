"""The SQL dialect: parsing, printing, planning."""
