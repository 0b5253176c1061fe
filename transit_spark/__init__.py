"""PySpark jobs for public-transport timetable data."""
