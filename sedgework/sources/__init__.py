"""Where rows come from and go to: Parquet tables, scratch tables and the snapshot store."""
