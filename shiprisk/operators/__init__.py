"""Row-level operators: cleaning, normalising, audits, joins, SQL guard."""
