"""Where rows come from and go to: Parquet runs, manifests and binary files."""
