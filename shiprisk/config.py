"""Run-time parameters shared by the jobs (all overridable per call)."""

from __future__ import annotations

# Revenue analysis only uses orders strictly before this date (pricing anomaly
# in the last months of the original data set).
DATA_CUTOFF = "2017-11-01"

# Same rule for the synthetic test bed built from /root/testdata, whose orders
# run from 1995-01 to 2001-08.
TESTBED_CUTOFF = "2001-06-01"

# Year of the "sales by month" saved question on the test bed.
TESTBED_SALES_YEAR = 2000

# Q2 drops region/country groups with fewer shipments than this.
MIN_SHIPMENTS = 100

# Top-k sizes of the reports.
TOP_REGIONS = 15
TOP_MODE_REGIONS = 20
TOP_PRODUCTS = 10
TOP_CATEGORIES = 15
PREVIEW_ROWS = 30

# Timestamp text of the raw CSV, e.g. 1/31/2018 22:56.
RAW_TIMESTAMP_FORMAT = "M/d/yyyy H:mm"
RAW_ENCODING = "ISO-8859-1"
