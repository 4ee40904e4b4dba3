"""sparkloom: a PySpark-native analytics engine with relational, wide-column and key-value surfaces."""
