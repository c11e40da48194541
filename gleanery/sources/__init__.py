"""Where rows come from and go to: tables, page extraction and export frames."""
