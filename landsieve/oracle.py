"""SQL text of the reshaped driver tables and of the screening steps, for checking results."""

from __future__ import annotations

BLOCKS = {
    "parcels": """
  SELECT o_orderkey AS ogc_fid,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey - o_orderkey % 2 AS STRING) END AS parcelnumb,
    replace(lower(r_name), ' ', '_') AS state2, lower(n_name) AS county,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice / 1000.0 END AS gisacre,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS usedesc,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS lbcs_ownership_desc,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 401 AS DOUBLE) END AS et_distance,
    CAST((o_orderkey * 53) % 2003 AS DOUBLE) AS hwy_distance,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '34.5' WHEN 3 THEN '69' WHEN 4 THEN '138.0' ELSE '345' END AS et_kv,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN ''
         ELSE 'City of ' || c_mktsegment || ' - (' || r_name || ')' END AS et_operator,
    CASE WHEN o_orderkey % 3 = 0 THEN 'City of ' || c_mktsegment || ' - (ASIA)' END AS est_operator,
    o_orderpriority AS zoning_type,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS zoning_subtype,
    c_mktsegment AS lbcs_site_desc,
    CASE o_orderkey % 5 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Relatively Low' WHEN 2 THEN 'Relatively High' WHEN 3 THEN 'Unlisted' END AS fema_nri_risk_rating,
    CASE o_orderkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'AE' WHEN 2 THEN 'A' ELSE 'X' END AS fema_flood_zone,
    CASE o_orderkey % 2 WHEN 0 THEN 'AREA OF MINIMAL FLOOD HAZARD' ELSE 'FLOODWAY' END AS fema_flood_zone_subtype,
    CASE WHEN o_orderkey % 19 = 0 THEN 0.0 WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice * 43.56 END AS ll_gissqft,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST((o_orderkey * 101) % 900000 AS DOUBLE) END AS ll_bldg_footprint_sqft,
    CAST((o_orderkey % 400) * 10 AS DOUBLE) AS x0, CAST((o_orderkey % 400) * 10 + 6 AS DOUBLE) AS x1,
    CAST(((o_orderkey * 7) % 300) * 10 AS DOUBLE) AS y0, CAST(((o_orderkey * 7) % 300) * 10 + 6 AS DOUBLE) AS y1
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "airports": """
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Runway' ELSE 'Airport ground' END AS feattype,
    CAST((s_suppkey * 131) % 4000 AS DOUBLE) AS x0, CAST((s_suppkey * 131) % 4000 + 60 AS DOUBLE) AS x1,
    CAST((s_suppkey * 211) % 3000 AS DOUBLE) AS y0, CAST((s_suppkey * 211) % 3000 + 60 AS DOUBLE) AS y1 FROM supplier""",
    "isochrones": """
  SELECT n_nationkey AS id, CAST(10 + 2 * (n_nationkey - n_nationkey % 5) AS DOUBLE) AS time,
    CAST(n_regionkey * 700 + 160 - 8 * (n_nationkey - n_nationkey % 5) AS DOUBLE) AS x0, CAST(n_regionkey * 700 + 400 + 8 * (n_nationkey - n_nationkey % 5) AS DOUBLE) AS x1,
    CAST(600 - 16 * (n_nationkey - n_nationkey % 5) AS DOUBLE) AS y0, CAST(1800 + 16 * (n_nationkey - n_nationkey % 5) AS DOUBLE) AS y1 FROM nation""",
    "lines": """
  SELECT p_partkey AS id, CAST((p_partkey * 97) % 4000 AS DOUBLE) AS x0, CAST((p_partkey * 97) % 4000 + 50 AS DOUBLE) AS x1,
    CAST((p_partkey * 173) % 3000 AS DOUBLE) AS y0, CAST((p_partkey * 173) % 3000 AS DOUBLE) AS y1,
    CASE p_partkey % 3 WHEN 0 THEN '69' WHEN 1 THEN '138' ELSE '345' END AS kv, p_brand AS operator FROM part""",
    "roads": """
  SELECT p_partkey AS id, CAST((p_partkey * 59) % 4000 AS DOUBLE) AS x0, CAST((p_partkey * 59) % 4000 AS DOUBLE) AS x1,
    CAST((p_partkey * 83) % 3000 AS DOUBLE) AS y0, CAST((p_partkey * 83) % 3000 + 30 AS DOUBLE) AS y1 FROM part""",
    "substations": """
  SELECT s_suppkey AS id, s_name AS operator, CAST((s_suppkey * 157) % 4000 AS DOUBLE) AS x0, CAST((s_suppkey * 157) % 4000 AS DOUBLE) AS x1,
    CAST((s_suppkey * 181) % 3000 AS DOUBLE) AS y0, CAST((s_suppkey * 181) % 3000 AS DOUBLE) AS y1 FROM supplier""",
    "zoning_rankings": """
  SELECT * FROM (VALUES ('1-URGENT','F',8.0e0,7.0e0),('2-HIGH','O',6.0e0,5.0e0),('3-MEDIUM','F',4.0e0,9.0e0),('3-MEDIUM','O',4.0e0,3.0e0)) AS t(zt, zst, zr, zsr)""",
    "site_rankings": """
  SELECT * FROM (VALUES ('BUILDING',9.0e0),('MACHINERY',3.0e0),('FURNITURE',CAST(NULL AS DOUBLE))) AS t(sd, sr)""",
    "fema_rankings": """
  SELECT * FROM (VALUES ('Very Low','X','AREA OF MINIMAL FLOOD HAZARD',10.0e0,10.0e0,9.0e0),('Relatively Low','AE','FLOODWAY',8.0e0,2.0e0,1.0e0),('Relatively High','A','AREA OF MINIMAL FLOOD HAZARD',2.0e0,4.0e0,6.0e0)) AS t(nri, fz, fst, nr, fr, fsr)""",
    # screening steps
    "s1": """
  SELECT * FROM parcels WHERE gisacre > 50.0 AND (usedesc IS NULL OR usedesc NOT IN ('MACHINERY','5-LOW')) AND (lbcs_ownership_desc IS NULL OR lbcs_ownership_desc NOT IN ('MACHINERY','5-LOW'))""",
    "s2": """
  SELECT * FROM s1 p WHERE NOT EXISTS (SELECT 1 FROM airports a WHERE a.feattype = 'Airport ground' AND p.x0 <= a.x1 AND a.x0 <= p.x1 AND p.y0 <= a.y1 AND a.y0 <= p.y1)""",
    "s3": "SELECT * FROM s2 WHERE et_distance <= 200.0",
    "s4": "SELECT * FROM s3 WHERE et_kv IS NOT NULL AND et_kv <> '' AND TRY_CAST(et_kv AS DOUBLE) >= 69.0",
    "s5": "SELECT * FROM s4 WHERE hwy_distance <= 1500.0",
    "s6": "SELECT * FROM s5 WHERE et_operator = 'City of BUILDING - (ASIA)' OR est_operator = 'City of BUILDING - (ASIA)'",
    "dt": """
  SELECT p.parcelnumb AS pn, MIN(i.time) AS t FROM s5 p JOIN isochrones i ON p.x0 <= i.x1 AND i.x0 <= p.x1 AND p.y0 <= i.y1 AND i.y0 <= p.y1 GROUP BY p.parcelnumb""",
    "s7": "SELECT s5.*, COALESCE(dt.t, 9999.0) AS drive_time FROM s5 LEFT JOIN dt ON s5.parcelnumb = dt.pn",
    # scoring, window form
    "n": """
  SELECT *, CASE WHEN MIN(gisacre) OVER () = MAX(gisacre) OVER () THEN 5.0e0 ELSE (gisacre - MIN(gisacre) OVER ()) / (MAX(gisacre) OVER () - MIN(gisacre) OVER ()) * 10 END AS gisacre_norm,
    CASE WHEN et_distance IS NULL THEN 5.0e0 WHEN MIN(et_distance) OVER () = MAX(et_distance) OVER () THEN 5.0e0 ELSE 10 - ((et_distance - MIN(et_distance) OVER ()) / (MAX(et_distance) OVER () - MIN(et_distance) OVER ()) * 10) END AS tn,
    CASE WHEN drive_time IS NULL THEN 5.0e0 WHEN MIN(drive_time) OVER () = MAX(drive_time) OVER () THEN 5.0e0 ELSE 10 - ((drive_time - MIN(drive_time) OVER ()) / (MAX(drive_time) OVER () - MIN(drive_time) OVER ()) * 10) END AS dn,
    CASE WHEN hwy_distance IS NULL THEN 5.0e0 WHEN MIN(hwy_distance) OVER () = MAX(hwy_distance) OVER () THEN 5.0e0 ELSE 10 - ((hwy_distance - MIN(hwy_distance) OVER ()) / (MAX(hwy_distance) OVER () - MIN(hwy_distance) OVER ()) * 10) END AS hn,
    CASE WHEN ll_gissqft = 0 OR ll_gissqft IS NULL THEN 5.0e0 ELSE LEAST(10.0, GREATEST(0.0, 10 - (ll_bldg_footprint_sqft / ll_gissqft * 10))) END AS bn FROM s7""",
    "m": """
  SELECT n.*, COALESCE(zr,5.0e0) zr1, COALESCE(zsr,5.0e0) zsr1, COALESCE(sr,5.0e0) sr1, COALESCE(nr,5.0e0) nr1, COALESCE(fr,5.0e0) fr1, COALESCE(fsr,5.0e0) fsr1
  FROM n LEFT JOIN zoning_rankings z ON zoning_type = zt AND zoning_subtype = zst LEFT JOIN site_rankings s ON lbcs_site_desc = sd
  LEFT JOIN fema_rankings f ON fema_nri_risk_rating = nri AND fema_flood_zone = fz AND fema_flood_zone_subtype = fst""",
    "c": """
  SELECT *, 0.2e0*(zr1+zsr1)/2 AS p_zoning, 0.15e0*sr1 AS p_site, 0.1e0*nr1 AS p_nri, 0.1e0*(fr1+fsr1) AS p_flood,
    0.2e0*gisacre_norm AS p_size, 0.1e0*dn AS p_drive, 0.15e0*tn AS p_transmission,
    0.2e0*(zr1+zsr1)/2 + 0.15e0*sr1 + 0.1e0*nr1 + 0.1e0*(fr1+fsr1) + 0.2e0*gisacre_norm + 0.1e0*dn + 0.15e0*tn AS mcda_score,
    (dn+hn+tn)/3 AS o_distance, 10 - (nr1+fr1+fsr1)/3 AS o_risk, (zr1+zsr1)/2 AS o_zoning,
    gisacre_norm + (dn+hn+tn)/3 + (10 - (nr1+fr1+fsr1)/3) + (zr1+zsr1)/2 AS mco_score FROM m""",
    "r": """
  SELECT *, CASE WHEN MIN(mcda_score) OVER () = MAX(mcda_score) OVER () THEN 5.0e0 ELSE (mcda_score-MIN(mcda_score) OVER ())/(MAX(mcda_score) OVER ()-MIN(mcda_score) OVER ())*10 END AS rn,
    CASE WHEN MIN(mco_score) OVER () = MAX(mco_score) OVER () THEN 5.0e0 ELSE (mco_score-MIN(mco_score) OVER ())/(MAX(mco_score) OVER ()-MIN(mco_score) OVER ())*10 END AS rm FROM c""",
}
USES = {
    "s1": ["parcels"], "s2": ["s1", "airports"], "s3": ["s2"], "s4": ["s3"], "s5": ["s4"], "s6": ["s5"],
    "dt": ["s5", "isochrones"], "s7": ["s5", "dt"], "n": ["s7"],
    "m": ["n", "zoning_rankings", "site_rankings", "fema_rankings"], "c": ["m"], "r": ["c"],
}


def with_blocks(body: str, *needed: str) -> str:
    """``body`` behind a WITH clause holding the named blocks and everything they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in USES.get(name, []):
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needed:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in ordered) + "\n" + body.strip()
