"""The standard parcel schema and the column groups every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# The standard parcel attributes, in their published order.
PARCEL_COLUMNS = [
    "ogc_fid", "geoid", "parcelnumb", "parcelnumb_no_formatting", "state_parcelnumb",
    "account_number", "tax_id", "alt_parcelnumb1", "alt_parcelnumb2", "alt_parcelnumb3",
    "usecode", "usedesc", "zoning", "zoning_description", "zoning_type", "zoning_subtype",
    "zoning_code_link", "zoning_id", "struct", "structno", "yearbuilt", "numstories",
    "numunits", "numrooms", "structstyle", "parvaltype", "improvval", "landval", "parval",
    "agval", "homestead_exemption", "saleprice", "saledate", "taxamt", "taxyear", "owntype",
    "owner", "unmodified_owner", "ownfrst", "ownlast", "owner2", "owner3", "owner4",
    "previous_owner", "mailadd", "mail_address2", "careof", "mail_addno", "mail_addpref",
    "mail_addstr", "mail_addsttyp", "mail_addstsuf", "mail_unit", "mail_city", "mail_state2",
    "mail_zip", "mail_country", "mail_urbanization", "original_mailing_address", "address",
    "address2", "saddno", "saddpref", "saddstr", "saddsttyp", "saddstsuf", "sunit", "scity",
    "original_address", "city", "county", "state2", "szip", "szip5", "urbanization",
    "ll_address_count", "location_name", "address_source", "legaldesc", "plat", "book", "page",
    "block", "lot", "neighborhood", "neighborhood_code", "subdivision", "lat", "lon",
    "fema_flood_zone", "fema_flood_zone_subtype", "fema_flood_zone_raw",
    "fema_flood_zone_data_date", "fema_nri_risk_rating", "qoz", "qoz_tract", "census_tract",
    "census_block", "census_blockgroup", "census_zcta", "census_elementary_school_district",
    "census_secondary_school_district", "census_unified_school_district", "ll_last_refresh",
    "sourceurl", "recrdareano", "deeded_acres", "gisacre", "sqft", "ll_gisacre", "ll_gissqft",
    "ll_bldg_footprint_sqft", "ll_bldg_count", "cdl_raw", "cdl_majority_category",
    "cdl_majority_percent", "cdl_date", "plss_township", "plss_section", "plss_range",
    "reviseddate", "path", "ll_stable_id", "ll_uuid", "ll_stack_uuid", "ll_row_parcel",
    "ll_updated_at", "precisely_id", "placekey", "dpv_status", "dpv_codes", "dpv_notes",
    "dpv_type", "cass_errorno", "rdi", "usps_vacancy", "usps_vacancy_date",
    "padus_public_access", "lbcs_activity", "lbcs_activity_desc", "lbcs_function",
    "lbcs_function_desc", "lbcs_structure", "lbcs_structure_desc", "lbcs_site",
    "lbcs_site_desc", "lbcs_ownership", "lbcs_ownership_desc", "housing_affordability_index",
    "population_density", "population_growth_past_5_years", "population_growth_next_5_years",
    "housing_growth_past_5_years", "housing_growth_next_5_years",
    "household_income_growth_next_5_years", "median_household_income",
    "transmission_line_distance", "roughness_rating", "highest_parcel_elevation",
    "lowest_parcel_elevation",
]

# Attributes that enrichment adds next to the standard ones.
ENRICHMENT_COLUMNS = [
    "et_distance", "et_kv", "et_operator", "est_operator", "hwy_distance", "drive_time",
]

# The attributes that are measured numbers; everything else stays text.
DOUBLE_COLUMNS = [
    "gisacre", "ll_gissqft", "ll_bldg_footprint_sqft", "et_distance", "hwy_distance",
    "drive_time",
]

# Accepted spellings of standard attributes.
COLUMN_ALIASES = {
    "parcel_number": "parcelnumb",
    "parcelid": "parcelnumb",
    "land_use": "usedesc",
    "use_description": "usedesc",
    "acres": "gisacre",
    "acreage": "gisacre",
    "geometry": "geom",
    "shape": "geom",
}

# Activities screened out when no exclusion sheet is given.
DEFAULT_EXCLUSIONS = [
    "Military base",
    "Emergency response or public-safety-related",
    "School or library",
    "Social, cultural, or religious assembly",
    "Power generation, control, monitor, or distribution",
    "Trains or other rail movement",
    "Activities associated with utilities (water, sewer, power, etc.)",
    "Promenading and other activities in parks",
    "Health care, medical, or treatment",
]

# A geometry is a group of columns: the exact shape plus its bounding box. The box makes
# Parquet min/max skipping and the cheap pre-test plain column comparisons.
BOX_COLUMNS = ["minx", "miny", "maxx", "maxy"]
GEOMETRY_COLUMNS = ["geom_wkb", "srid", *BOX_COLUMNS, "is_rect"]
GEOMETRY_TYPES = {
    "geom_wkb": T.BinaryType(),
    "srid": T.IntegerType(),
    **{c: T.DoubleType() for c in BOX_COLUMNS},
    "is_rect": T.BooleanType(),
}


def column_type(name: str) -> T.DataType:
    """Type of a standard, enrichment or geometry column."""
    if name in GEOMETRY_TYPES:
        return GEOMETRY_TYPES[name]
    return T.DoubleType() if name in DOUBLE_COLUMNS else T.StringType()


PARCEL_SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in PARCEL_COLUMNS])
