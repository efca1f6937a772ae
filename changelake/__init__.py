"""changelake: change-data replication, table maintenance and SQL on plain PySpark."""
