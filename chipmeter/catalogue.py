"""Every query of the library by name, with the SQL that gives the same rows."""

from .plans import extra, files, maps, pairs, raster, records, search, streams, summaries

QUERIES: dict = {**raster.Q, **pairs.Q, **records.Q, **extra.Q, **streams.Q, **files.Q, **search.Q, **summaries.Q, **maps.Q}
ORACLES: dict = {**raster.SQL, **pairs.SQL, **records.SQL, **extra.SQL, **streams.SQL, **files.SQL, **search.SQL, **summaries.SQL, **maps.SQL}
FLAGSHIP = "A15_area_summary"
