"""SQL types of the data model. x is longitude, y latitude, m the time in epoch milliseconds."""

VERTEX = "STRUCT<x:DOUBLE,y:DOUBLE,m:DOUBLE>"
TRAJECTORY = f"ARRAY<{VERTEX}>"
MULTI = f"ARRAY<{TRAJECTORY}>"
POINT = "STRUCT<x:DOUBLE,y:DOUBLE>"
LINE = f"ARRAY<{POINT}>"
POLYGON = f"ARRAY<ARRAY<{POINT}>>"
