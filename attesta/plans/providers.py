"""Provider records landed as JSON, built from whole tables, and the tables they become."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.sources.providers import normalised
from attesta.sources.tables import table


def _landed(spark, d, name: str, order: str, record: str):
    """The rows of a table as provider records: a JSON object each, and when it landed."""
    return table(spark, d, name).select(F.expr(order).alias("landed_at"), F.expr(f"to_json({record})").alias("record"))


#: Table, landing order, record and settings of each specification.
FEEDS = {
    "world_bank_countries": ("customer", "c_custkey", """named_struct('id', if(c_custkey % 10 = 0, ' ', null), 'iso2Code', concat('C', c_custkey % 97), 'name', if(c_custkey % 13 = 0, '', c_name), 'region', named_struct('id', c_nationkey, 'value', c_mktsegment),
        'longitude', cast(c_custkey % 180 as string), 'latitude', if(c_custkey % 4 = 0, 'NA', cast(c_custkey % 90 as string)))""", {}),
    "world_bank_indicators": ("part", "p_partkey", "named_struct('id', concat(p_brand, '.', p_size), 'name', p_name, 'unit', if(p_partkey % 3 = 0, '', 'kg'), 'source', named_struct('id', p_size, 'value', p_type))", {}),
    "world_bank_observations": ("orders", "o_orderkey", """named_struct('countryiso3code', if(o_orderkey % 3 = 0, '', concat('I', o_custkey % 40)), 'country', named_struct('id', concat('D', o_custkey % 40)), 'indicator', named_struct('id', o_orderpriority),
        'date', if(o_orderkey % 17 = 0, null, date_format(o_orderdate, 'yyyy')), 'value', if(o_orderkey % 5 = 0, 'NA', cast(o_custkey as string)))""", {"indicator": "none"}),
    "un_sdg_geoareas": ("nation", "n_nationkey", "named_struct('geoAreaCode', if(n_nationkey % 2 = 0, n_nationkey, null), 'code', concat('c', n_nationkey), 'title', n_name)", {}),
    "un_sdg_goals": ("region", "r_regionkey", "named_struct('goalCode', r_regionkey, 'title', if(r_regionkey % 2 = 0, '', r_name), 'description', lower(r_name))", {}),
    "un_sdg_indicators": ("part", "p_partkey", "named_struct('indicatorCode', concat(p_size, '.', p_partkey % 7), 'title', p_name)", {}),
    "un_sdg_observations": ("lineitem", "l_orderkey * 10 + l_linenumber", """named_struct('seriesCode', if(l_linenumber = 1, null, l_returnflag), 'indicator', 'i1', 'geoAreaCode', l_suppkey, 'timePeriod', date_format(l_shipdate, 'yyyy'), 'nature', l_linestatus,
        'sex', if(l_linenumber % 2 = 0, 'F', ''), 'dimensions', named_struct('sex', 'M', 'unit', 'n'), 'value', cast(l_partkey as string))""", {}),
    "census_observations": ("supplier", "s_suppkey", "named_struct('NAME', s_name, 'state', cast(s_nationkey as string), 'county', cast(s_suppkey % 50 as string), 'B01', cast(s_suppkey as string), 'B02', if(s_suppkey % 7 = 0, '(NA)', concat('1,', lpad(s_suppkey % 900, 3, '0'))))",
        {"metrics": ["NAME", "B01", "B02", "B03"], "dataset": "acs", "year": 2022}),
    "bls_series": ("part", "p_partkey", "named_struct('series_id', concat('S', p_size), 'catalog', named_struct('series_title', p_name, 'survey_name', p_type, 'seasonality', if(p_partkey % 2 = 0, p_brand, '')))", {}),
    "bls_observations": ("events", "event_id", """named_struct('series_id', concat('U', user_id % 20), 'year', date_format(ts, 'yyyy'), 'period', if(event_id % 19 = 0, '', date_format(ts, 'dd')), 'periodName', event_type, 'latest', if(event_id % 2 = 0, 'true', null),
        'value', if(event_id % 6 = 0, '--', cast(event_id as string)))""", {}),
    "bea_observations": ("orders", "o_orderkey", """named_struct('Code', if(o_orderkey % 4 = 0, null, o_orderpriority), 'GeoFIPS', if(o_orderkey % 9 = 0, '', cast(o_custkey % 30 as string)), 'Year', date_format(o_orderdate, 'yyyy'), 'CL_UNIT', 'USD', 'DataValue', if(o_orderkey % 8 = 0, '(NA)', cast(o_custkey as string)))""", {"dataset": "Regional"}),
    "eia_observations": ("lineitem", "l_orderkey * 10 + l_linenumber", """named_struct('period', date_format(l_shipdate, 'yyyy-MM'), 'stateid', if(l_linenumber = 1, '', l_returnflag), 'area', l_linestatus, 'price', cast(l_partkey as string), 'price-units', 'cents', 'sales', if(l_linenumber = 2, null, cast(l_suppkey as string)))""", {"metrics": ["price", "sales"], "route": "retail"}),
    "epa_records": ("orders", "o_orderkey", "named_struct('a', cast(o_custkey % 100 as string), 'b', o_orderstatus)", {"table": "tri"}),
    "usgs_water": ("events", "event_id", "named_struct('id', if(event_id % 5 = 0, null, cast(event_id % 3000 as string)), 'properties', named_struct('monitoring_location_id', user_id, 'parameter_code', event_type, 'time', date_format(ts, 'yyyy-MM-dd'), 'value', cast(event_id as string), 'unit_of_measure', if(event_id % 2 = 0, 'ft', '')), 'n', cast(event_id as string))", {"collection": "daily"}),
    "ncei_observations": ("events", "event_id", "named_struct('datatype', if(event_id % 3 = 0, '', event_type), 'date', date_format(ts, 'yyyy-MM-dd'), 'stationid', user_id, 'value', if(event_id % 6 = 0, 'NaN', cast(event_id as string)), 'latitude', cast(event_id % 90 as string))", {}),
    "erddap_datasets": ("part", "p_partkey", "named_struct('Dataset ID', if(p_partkey % 100 = 1, 'allDatasets', p_brand), 'Title', if(p_partkey % 2 = 0, '', p_name), 'Institution', p_type, 'griddap', if(p_size % 2 = 0, 'g', ''), 'tabledap', if(p_size % 3 = 0, 't', ''))", {"server": "https://erddap.example"}),
    "erddap_observations": ("events", "event_id", "named_struct('time', date_format(ts, 'yyyy-MM-dd'), 'station', user_id, 'latitude', cast(event_id % 90 as string), 'temp', cast(event_id as string), 'salt', if(event_id % 4 = 0, '--', cast(event_id % 40 as string)))", {"metrics": ["time", "temp", "salt", "latitude"], "dataset": "buoys"}),
    "ioos_datasets": ("pages", "page_id", "named_struct('id', if(page_id % 4 = 0, '', cast(page_id as string)), 'name', concat('p', page_id), 'title', url, 'organization', named_struct('title', page_id % 5))", {}),
    "space_weather": ("events", "event_id", "named_struct('flrID', if(event_id % 2 = 0, concat('f', event_id % 500), null), 'messageID', concat('m', event_id % 500), 'peakTime', date_format(ts, 'yyyy-MM-dd'), 'classType', if(event_id % 3 = 0, '', event_type), 'location', user_id)", {"event_type": "FLR"}),
    "small_bodies": ("part", "p_partkey", "named_struct('spkid', if(p_partkey % 3 = 0, '', cast(p_partkey as string)), 'pdes', p_brand, 'class', p_type, 'neo', if(p_partkey % 2 = 0, 'Y', 'N'), 'pha', null, 'H', cast(p_size as string))", {}),
    "close_approaches": ("lineitem", "l_orderkey * 10 + l_linenumber", "named_struct('des', if(l_linenumber = 1, '', cast(l_partkey as string)), 'fullname', concat('x', l_suppkey), 'cd', date_format(l_shipdate, 'yyyy-MM'), 'dist', cast(l_orderkey as string), 'orbit_id', if(l_linenumber = 2, null, l_linenumber))", {}),
    "exoplanets": ("part", "p_partkey", "named_struct('pl_name', if(p_size % 2 = 0, p_name, ''), 'toi', p_size, 'tic_id', p_brand, 'disc_year', cast(p_partkey as string))", {"table": "ps"}),
    "archive_items": ("pages", "page_id", "named_struct('identifier', concat(' i', page_id % 200, ' '), 'title', url, 'mediatype', 'web', 'date', if(page_id % 5 = 0, '', '2024'), 'description', array(concat('d', page_id % 3), 'x'), 'creator', if(page_id % 2 = 0, array('a', ' ', concat('c', page_id % 4)), null), 'subject', concat('s', page_id % 6))", {}),
    "archive_item_versions": ("pages", "page_id", "named_struct('identifier', concat('i', page_id % 50), 'title', concat('t', page_id % 150))", {}),
    "archive_files": ("pages", "page_id div 100", "named_struct('identifier', concat('i', page_id % 20), 'name', if(page_id % 11 = 0, '', concat('f', page_id % 60)), 'size', if(page_id % 3 = 0, '-1', cast(page_id as string)), 'private', if(page_id % 2 = 0, 'TRUE', null), 'format', if(page_id % 4 = 0, null, 'warc'), 'md5', concat('m', page_id), 'sha1', concat('s', page_id))", {"version": "landed_at"}),
    "wayback_captures": ("pages", "page_id", "named_struct('target', concat('t', page_id % 20), 'timestamp', if(page_id % 7 = 0, null, cast(2000 + page_id % 9 as string)), 'original', if(page_id % 2 = 0, url, null), 'length', if(page_id % 3 = 0, null, cast(page_id as string)), 'mimetype', if(page_id % 5 = 0, 'text/html', null), 'statuscode', if(page_id % 4 = 0, '200', ''), 'digest', concat('d', page_id), 'url', if(page_id % 6 = 0, concat('r', page_id), null))", {}),
}

#: Columns left out of the comparison: hashes of the record, whose text is this library's own.
OWN = {"epa_records": ["record_sha256"], "usgs_water": ["feature_id"], "archive_items": ["metadata_sha256"], "archive_item_versions": ["metadata_sha256"]}


def _query(name: str):
    source, order, record, settings = FEEDS[name]

    def query(spark, d):
        found = normalised(_landed(spark, d, source, order, record), name, **settings).drop(*OWN.get(name, []))
        return found.select(*(F.col(c) for c, kind in found.dtypes if c not in EMPTY.get(name, [])))

    query.__doc__ = f"Records of {source} in the shape of {name}, normalised."
    return query


#: Columns that the built records leave empty; the tests of the specifications cover them.
EMPTY = {
    "world_bank_countries": ["income_level", "lending_type", "capital_city"], "world_bank_indicators": ["source_note", "source_organization"], "world_bank_observations": ["unit", "obs_status", "source_id"],
    "un_sdg_indicators": [], "usgs_water": ["statistic_id"], "ncei_observations": ["unit", "longitude"], "erddap_observations": ["longitude"], "ioos_datasets": ["notes"], "space_weather": ["end_time", "status"],
    "small_bodies": ["kind", "diameter_km", "semimajor_axis_au", "eccentricity", "inclination_deg", "moid_au"], "close_approaches": ["distance_min_au", "distance_max_au", "relative_velocity_km_s", "absolute_magnitude"],
    "exoplanets": ["discovery_method", "orbital_period_days", "radius_earth", "mass_earth", "stellar_temperature_k", "distance_pc"],
}

QUERIES = {f"provider_{name}": _query(name) for name in FEEDS}


def _last(columns: str, source: str, key: str, order: str, where: str = "true", ties: str = "") -> str:
    """Of rows with one key the one landed last, and when the key was first and last seen; ``ties`` order rows landed at once."""
    if ties:
        return f"""SELECT * EXCLUDE (o_), min(o_) OVER w AS first_seen_at, max(o_) OVER w AS fetched_at FROM (SELECT {columns}, {order} AS o_ FROM {source}) WHERE {where}
        WINDOW w AS (PARTITION BY {key}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY o_ DESC, {ties}) = 1"""
    return f"""SELECT * EXCLUDE (o_), min(o_) OVER w AS first_seen_at, max(o_) OVER w AS fetched_at FROM (SELECT {columns}, {order} AS o_ FROM {source}) WHERE {where}
        WINDOW w AS (PARTITION BY {key}) QUALIFY o_ = max(o_) OVER w"""


_LINE = "l_orderkey * 10 + l_linenumber"
_YEAR = "strftime({}, '%Y')"
_DAY = "strftime(ts, '%Y-%m-%d')"

SQL = {
    "provider_world_bank_countries": _last("'C' || c_custkey % 97 AS country_code, 'C' || c_custkey % 97 AS iso2_code, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name, CAST(c_nationkey AS VARCHAR) AS region_code, c_mktsegment AS region_name, CAST(c_custkey % 180 AS DOUBLE) AS longitude, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS latitude", "customer", "country_code", "c_custkey", "name IS NOT NULL"),
    "provider_world_bank_indicators": _last("p_brand || '.' || p_size AS indicator_code, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'kg' END AS unit, CAST(p_size AS VARCHAR) AS source_id", "part", "indicator_code", "p_partkey"),
    "provider_world_bank_observations": _last(f"CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'I' END || o_custkey % 40 AS country_code, o_orderpriority AS indicator_code, CASE WHEN o_orderkey % 17 <> 0 THEN {_YEAR.format('o_orderdate')} END AS period, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS value_numeric, CASE WHEN o_orderkey % 5 = 0 THEN 'NA' END AS value_text", "orders", "country_code, indicator_code, period", "o_orderkey", "period IS NOT NULL"),
    "provider_un_sdg_geoareas": _last("CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'c' END || n_nationkey AS code, n_name AS name", "nation", "code", "n_nationkey"),
    "provider_un_sdg_goals": _last("CAST(r_regionkey AS VARCHAR) AS code, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) ELSE r_name END AS title, lower(r_name) AS description", "region", "code", "r_regionkey"),
    "provider_un_sdg_indicators": _last("p_size || '.' || p_partkey % 7 AS code, p_name AS description", "part", "code", "p_partkey"),
    "provider_un_sdg_observations": _last(f"""CASE WHEN l_linenumber = 1 THEN 'i1' ELSE l_returnflag END AS series_code, CAST(l_suppkey AS VARCHAR) AS geo_area_code, {_YEAR.format('l_shipdate')} AS period, l_linestatus AS nature, CASE WHEN l_linenumber % 2 = 0 THEN '{{"sex":"F","unit":"n"}}' ELSE '{{"sex":"M","unit":"n"}}' END AS dimensions,
        CAST(l_partkey AS DOUBLE) AS value_numeric, CAST(NULL AS VARCHAR) AS value_text""", "lineitem", "series_code, geo_area_code, period, nature, dimensions", _LINE, ties="value_numeric DESC"),
    "provider_census_observations": _last("""'acs' AS dataset, '2022' AS year, s_name AS geography_name, '{"county":"' || s_suppkey % 50 || '","state":"' || s_nationkey || '"}' AS geography, m AS metric_code, CASE WHEN m = 'B01' THEN s_suppkey WHEN s_suppkey % 7 <> 0 THEN 1000 + s_suppkey % 900 END::DOUBLE AS value_numeric,
        CASE WHEN m = 'B02' AND s_suppkey % 7 = 0 THEN '(NA)' END AS value_text""", "supplier, (VALUES ('B01'), ('B02')) v(m)", "geography, metric_code", "s_suppkey"),
    "provider_bls_series": _last("'S' || p_size AS series_id, p_name AS title, p_type AS survey_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS seasonality", "part", "series_id", "p_partkey"),
    "provider_bls_observations": _last(f"'U' || user_id % 20 AS series_id, {_YEAR.format('ts')} AS year, CASE WHEN event_id % 19 <> 0 THEN strftime(ts, '%d') END AS period, event_type AS period_name, event_id % 2 = 0 AS latest, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS DOUBLE) END AS value_numeric, CASE WHEN event_id % 6 = 0 THEN '--' END AS value_text", "events", "series_id, year, period", "event_id", "period IS NOT NULL"),
    "provider_bea_observations": _last(f"""'Regional' AS dataset, CASE WHEN o_orderkey % 4 = 0 THEN 'Regional' ELSE o_orderpriority END AS metric_code, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(o_custkey % 30 AS VARCHAR) END AS geography_id, CAST(NULL AS VARCHAR) AS geography_name, {_YEAR.format('o_orderdate')} AS period, 'USD' AS unit,
        CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS value_numeric, CASE WHEN o_orderkey % 8 = 0 THEN '(NA)' END AS value_text, '{{"CL_UNIT":"USD",' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '"Code":"' || o_orderpriority || '",' END || '"GeoFIPS":"' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 30 AS VARCHAR) END || '","Year":"' || {_YEAR.format('o_orderdate')} || '"}}' AS dimensions""", "orders", "metric_code, geography_id, period, dimensions", "o_orderkey"),
    "provider_eia_observations": _last("""'retail' AS route, m AS metric_code, strftime(l_shipdate, '%Y-%m') AS period, CASE WHEN l_linenumber = 1 THEN l_linestatus ELSE l_returnflag END AS geography_id, CAST(NULL AS VARCHAR) AS geography_name, CASE WHEN m = 'price' THEN 'cents' END AS unit, CASE WHEN m = 'price' THEN l_partkey ELSE l_suppkey END::DOUBLE AS value_numeric, CAST(NULL AS VARCHAR) AS value_text,
        '{"area":"' || l_linestatus || '","period":"' || strftime(l_shipdate, '%Y-%m') || '","stateid":"' || CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END || '"}' AS dimensions, l_linenumber AS n_""", "lineitem, (VALUES ('price'), ('sales')) v(m)", "metric_code, period, dimensions", _LINE, "NOT (metric_code = 'sales' AND n_ = 2)", "geography_id DESC, value_numeric DESC").replace("EXCLUDE (o_)", "EXCLUDE (o_, n_)"),
    "provider_epa_records": "SELECT 'tri' AS table_name, min(o_orderkey) AS first_seen_at, max(o_orderkey) AS fetched_at FROM orders GROUP BY o_custkey % 100, o_orderstatus",
    "provider_usgs_water": _last(f"CASE WHEN event_id % 5 = 0 THEN '#' || event_id ELSE CAST(event_id % 3000 AS VARCHAR) END AS k_, 'daily' AS collection, CAST(user_id AS VARCHAR) AS location_id, event_type AS parameter_code, {_DAY} AS period, CASE WHEN event_id % 2 = 0 THEN 'ft' END AS unit, CAST(event_id AS DOUBLE) AS value_numeric, CAST(NULL AS VARCHAR) AS value_text", "events", "k_", "event_id").replace("EXCLUDE (o_)", "EXCLUDE (o_, k_)"),
    "provider_ncei_observations": _last(f"'ncei-cdo' AS dataset, CAST(user_id AS VARCHAR) AS native_id, CASE WHEN event_id % 3 = 0 THEN 'value' ELSE event_type END AS metric_code, {_DAY} AS period, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS DOUBLE) END AS value_numeric, CASE WHEN event_id % 6 = 0 THEN 'NaN' END AS value_text, CAST(event_id % 90 AS DOUBLE) AS latitude", "events", "native_id, metric_code, period", "event_id"),
    "provider_erddap_datasets": _last("'https://erddap.example' AS server, p_brand AS dataset_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS title, p_type AS institution, CASE WHEN p_size % 6 = 0 THEN 'both' WHEN p_size % 2 = 0 THEN 'griddap' WHEN p_size % 3 = 0 THEN 'tabledap' ELSE 'unknown' END AS service_kind", "part", "dataset_id", "p_partkey", "o_ % 100 <> 1"),
    "provider_erddap_observations": _last(f"'buoys' AS dataset, CAST(user_id AS VARCHAR) AS native_id, CAST(user_id AS VARCHAR) AS station_id, m AS metric_code, {_DAY} AS period, CASE WHEN m = 'temp' THEN event_id WHEN event_id % 4 <> 0 THEN event_id % 40 END::DOUBLE AS value_numeric, CASE WHEN m = 'salt' AND event_id % 4 = 0 THEN '--' END AS value_text, CAST(event_id % 90 AS DOUBLE) AS latitude", "events, (VALUES ('temp'), ('salt')) v(m)", "native_id, metric_code, period", "event_id"),
    "provider_ioos_datasets": _last("CASE WHEN page_id % 4 = 0 THEN 'p' ELSE '' END || page_id AS dataset_id, 'p' || page_id AS name, url AS title, CAST(page_id % 5 AS VARCHAR) AS organization", "pages", "dataset_id", "page_id"),
    "provider_space_weather": _last(f"'FLR' AS event_type, CASE WHEN event_id % 2 = 0 THEN 'f' ELSE 'm' END || event_id % 500 AS native_id, {_DAY} AS event_time, CASE WHEN event_id % 3 = 0 THEN 'FLR' ELSE event_type END AS title, CAST(user_id AS VARCHAR) AS location", "(SELECT event_id, ts, user_id, event_type FROM events)", "native_id", "event_id"),
    "provider_small_bodies": _last("CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS native_id, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS spkid, p_brand AS designation, p_type AS orbit_class, p_partkey % 2 = 0 AS is_neo, false AS is_pha, CAST(p_size AS DOUBLE) AS absolute_magnitude", "part", "native_id", "p_partkey"),
    "provider_close_approaches": _last("CASE WHEN l_linenumber = 1 THEN 'x' || l_suppkey ELSE CAST(l_partkey AS VARCHAR) END AS designation, 'Earth' AS body, strftime(l_shipdate, '%Y-%m') AS approach_time, CASE WHEN l_linenumber <> 2 THEN CAST(l_linenumber AS VARCHAR) END AS orbit_id, 'x' || l_suppkey AS full_name, CAST(l_orderkey AS DOUBLE) AS distance_au", "lineitem", "designation, approach_time, orbit_id", _LINE, ties="full_name DESC, distance_au DESC"),
    "provider_exoplanets": _last("'ps' AS table_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS planet_name, p_brand AS host_name, CAST(p_partkey AS DOUBLE) AS discovery_year", "part", "planet_name, host_name", "p_partkey"),
    "provider_archive_items": _last("""'i' || page_id % 200 AS identifier, url AS title, 'web' AS mediatype, CASE WHEN page_id % 5 <> 0 THEN '2024' END AS item_date, 'd' || page_id % 3 || '; x' AS description,
        CASE WHEN page_id % 2 = 0 THEN '["a","c' || page_id % 4 || '"]' ELSE '[]' END AS creators, '[]' AS collections, '["s' || page_id % 6 || '"]' AS subjects""", "pages", "identifier", "page_id"),
    "provider_archive_item_versions": "SELECT 'i' || page_id % 50 AS identifier, min(page_id) AS first_seen_at, max(page_id) AS fetched_at FROM pages GROUP BY page_id % 50, page_id % 150",
    "provider_archive_files": _last("""'i' || page_id % 20 AS identifier, CASE WHEN page_id % 11 <> 0 THEN 'f' || page_id % 60 END AS file_name, CASE WHEN page_id % 4 <> 0 THEN 'warc' END AS format, 'm' || page_id AS md5, 's' || page_id AS sha1, page_id % 2 = 0 AS private,
        CASE WHEN page_id % 3 <> 0 THEN page_id END AS size_bytes, max(page_id // 100) FILTER (page_id % 11 <> 0) OVER (PARTITION BY page_id % 20) AS p_""", "pages", "identifier, file_name", "page_id // 100", "file_name IS NOT NULL", "format DESC NULLS LAST, md5 DESC")
        .replace("EXCLUDE (o_)", "EXCLUDE (o_, p_)") + " AND max(o_) OVER w = p_",
    "provider_wayback_captures": """WITH c AS (SELECT 't' || page_id % 20 AS target_url, CASE WHEN page_id % 7 <> 0 THEN CAST(2000 + page_id % 9 AS VARCHAR) END AS "timestamp", CASE WHEN page_id % 2 = 0 THEN url ELSE 't' || page_id % 20 END AS original_url, page_id AS p FROM pages)
        SELECT target_url, "timestamp", original_url, CASE WHEN bool_or(p % 5 = 0) THEN 'text/html' END AS mimetype, CASE WHEN bool_or(p % 4 = 0) THEN '200' END AS status_code, 'd' || max(p) AS digest, max(p) FILTER (p % 3 <> 0) AS length_bytes,
        CASE WHEN max(p) % 6 = 0 THEN 'r' || max(p) ELSE 'https://web.archive.org/web/' || "timestamp" || '/' || original_url END AS replay_url, min(p) AS first_seen_at, max(p) AS fetched_at FROM c WHERE "timestamp" IS NOT NULL GROUP BY target_url, "timestamp", original_url""",
}
