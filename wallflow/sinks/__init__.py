"""Writers: flow tables, scripts and reports."""
