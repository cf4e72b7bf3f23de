"""Views over the test tables, registered queries with their SQL, and end-to-end plans."""
