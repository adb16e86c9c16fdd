"""Land-parcel screening and ranking as Spark jobs."""

from .plans.enrichment import Enrichment, enrich
from .plans.loading import load_all, load_layers, load_parcels, run_sql_steps, schema_check
from .plans.mapdata import map_data
from .plans.site_selection import Settings, screen, screening_funnel, site_selection
from .session import Scratch, build_session

__all__ = [
    "Enrichment", "Scratch", "Settings", "build_session", "enrich", "load_all", "load_layers", "load_parcels", "map_data", "run_sql_steps",
    "schema_check", "screen", "screening_funnel", "site_selection",
]
