"""DataFrame operators: queues, statistics, upserts, matching, search, keys, index pages."""
