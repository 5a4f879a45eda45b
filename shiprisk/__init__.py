"""shiprisk: Spark-native supply-chain and delivery-risk analytics.

Every job is a function from DataFrames to a DataFrame built from native
Spark expressions, so Catalyst can push filters, prune columns and pick
join strategies.  See README.md for the module map.
"""

from shiprisk.model import SupplyTables

__all__ = ["SupplyTables"]
