"""Where rows come from: Parquet tables, derived crawl relations, response documents, queues."""
