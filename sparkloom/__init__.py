"""sparkloom: a semantic analytics engine on Spark SQL."""
