"""Records of public data providers to tables: one specification each, one way to apply them.

A record is a JSON object as text, as the payload readers give it. A specification names the key, the columns with the
fields they come from in order of preference, which columns are required, and for observations where the value is, or
that each of the requested fields is one (wide to long). Of records with one key the one landed last stays, with the
time the key was first seen. Where a specification keeps columns, the last value that is there stays instead. Everything is a projection and one grouping by key, which the map side reduces first.

Texts are trimmed, empty ones count as missing. An object stands for its value, name, title or description, a list for
its items joined. Values within dimensions and hashes are compared as texts; a record without identifier is known by the
hash of its fields, so equal ones are one. A record that is no JSON object is left out; no records give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import derive

# The providers' field names. "=x" is the text x, "@x" a setting, "#" the hash of the record.
SPECS: dict[str, dict] = {
    "world_bank_countries": {
        "key": ["country_code"], "required": ["country_code", "name"],
        "columns": {"country_code": ["id", "iso2Code"], "iso2_code": ["iso2Code"], "name": ["name"], "region_code": ["region.id"], "region_name": ["region.value"], "income_level": ["incomeLevel.value"], "lending_type": ["lendingType.value"], "capital_city": ["capitalCity"]},
        "numbers": {"longitude": "longitude", "latitude": "latitude"}, "family": "statistics",
    },
    "world_bank_indicators": {
        "key": ["indicator_code"], "required": ["indicator_code", "name"],
        "columns": {"indicator_code": ["id"], "name": ["name"], "unit": ["unit"], "source_id": ["source.id"], "source_note": ["sourceNote"], "source_organization": ["sourceOrganization"]},
    },
    "world_bank_observations": {
        "key": ["country_code", "indicator_code", "period", "source_id"], "required": ["country_code", "indicator_code", "period"],
        "columns": {"country_code": ["countryiso3code", "country_id", "country.id"], "indicator_code": ["indicator.id", "@indicator"], "period": ["date"], "source_id": ["source", "="], "unit": ["unit"], "obs_status": ["obs_status"]},
        "value": ["value"], "family": "statistics",
    },
    "un_sdg_geoareas": {"key": ["code"], "required": ["code", "name"], "columns": {"code": ["geoAreaCode", "code", "id"], "name": ["geoAreaName", "name", "title"]}},
    "un_sdg_goals": {"key": ["code"], "required": ["code", "title"], "columns": {"code": ["code", "goalCode", "id"], "title": ["title", "description", "name"], "description": ["description"]}},
    "un_sdg_indicators": {"key": ["code"], "required": ["code", "description"], "columns": {"code": ["code", "indicatorCode", "id"], "description": ["description", "title", "name"]}},
    "un_sdg_observations": {
        "key": ["series_code", "geo_area_code", "period", "dimensions", "nature"], "required": ["series_code", "geo_area_code", "period"],
        "columns": {"series_code": ["seriesCode", "series", "indicator", "indicatorCode"], "geo_area_code": ["geoAreaCode", "areaCode"], "period": ["timePeriod", "year", "period"], "nature": ["nature", "natureCode", "="]},
        "value": ["value", "valueNumeric"], "family": "statistics",
        "only": ["sex", "age", "location", "educationLevel", "typeOfProduct", "typeOfOccupation", "reportingType"], "within": "dimensions",
    },
    "census_observations": {
        "key": ["dataset", "year", "geography", "metric_code"], "required": [], "wide": True, "family": "national", "without": ["NAME"], "dimensions": "geography",
        "columns": {"dataset": ["@dataset"], "year": ["@year"], "geography_name": ["NAME"]},
    },
    "bls_series": {
        "key": ["series_id"], "required": ["series_id"],
        "columns": {"series_id": ["@series_id", "series_id"], "title": ["catalog.series_title"], "survey_name": ["catalog.survey_name"], "seasonality": ["catalog.seasonality"]},
    },
    "bls_observations": {
        "key": ["series_id", "year", "period"], "required": ["year", "period"], "value": ["value"], "family": "national", "flags": {"latest": "latest"}, "truth": "archive",
        "columns": {"series_id": ["@series_id", "series_id"], "year": ["year"], "period": ["period"], "period_name": ["periodName"]},
    },
    "bea_observations": {
        "key": ["dataset", "metric_code", "geography_id", "period", "dimensions"], "required": [], "value": ["DataValue", "Value"], "family": "national", "without": ["DataValue", "Value"],
        "columns": {"dataset": ["@dataset"], "metric_code": ["Code", "@dataset"], "geography_id": ["GeoFips", "GeoFIPS", "=unknown"], "geography_name": ["GeoName"], "period": ["TimePeriod", "Year", "=unknown"], "unit": ["CL_UNIT"]},
    },
    "eia_observations": {
        "key": ["route", "metric_code", "period", "dimensions"], "required": [], "wide": True, "family": "national", "without": [], "without_suffix": "-units", "unit_suffix": "-units",
        "columns": {"route": ["@route"], "period": ["period", "=unknown"], "geography_id": ["stateid", "location", "area", "region"], "geography_name": ["stateDescription", "location-name", "area-name", "regionName"]},
    },
    "epa_records": {"key": ["table_name", "record_sha256"], "required": [], "columns": {"table_name": ["@table"], "record_sha256": ["#"]}},
    "usgs_water": {
        "key": ["collection", "feature_id"], "required": [], "value": ["properties.value"], "family": "national",
        "columns": {"collection": ["@collection"], "feature_id": ["id", "#"], "location_id": ["properties.monitoring_location_id"], "parameter_code": ["properties.parameter_code"], "statistic_id": ["properties.statistic_id", "="], "period": ["properties.time", "=unknown"], "unit": ["properties.unit_of_measure"]},
    },
    "ncei_observations": {
        "key": ["dataset", "native_id", "metric_code", "period"], "required": [], "value": ["value"], "family": "earth", "numbers": {"longitude": "longitude", "latitude": "latitude"},
        "columns": {"dataset": ["datasetid", "@dataset", "=ncei-cdo"], "native_id": ["station", "stationid", "#"], "metric_code": ["datatype", "datatypeid", "=value"], "period": ["date", "mindate", "=unknown"], "unit": ["attributes"]},
    },
    "erddap_datasets": {
        "key": ["server", "dataset_id"], "required": ["dataset_id"], "never": {"dataset_id": "allDatasets"},
        "columns": {"server": ["@server"], "dataset_id": ["Dataset ID", "datasetID", "dataset_id"], "title": ["Title", "Dataset ID", "datasetID", "dataset_id"], "institution": ["Institution"]},
        "present": {"service_kind": {"griddap": "griddap", "tabledap": "tabledap"}},
    },
    "erddap_observations": {
        "key": ["dataset", "native_id", "metric_code", "period"], "required": [], "wide": True, "family": "earth", "numbers": {"longitude": "longitude", "latitude": "latitude"},
        "never_metrics": ["time", "latitude", "longitude", "depth", "altitude", "station", "station_id", "site", "id"],
        "columns": {"dataset": ["@dataset"], "native_id": ["id", "station", "station_id", "#"], "period": ["time", "=unknown"], "station_id": ["station", "station_id", "site"]},
    },
    "ioos_datasets": {"key": ["dataset_id"], "required": ["dataset_id"], "columns": {"dataset_id": ["id", "name"], "name": ["name"], "title": ["title"], "organization": ["organization.title"], "notes": ["notes"]}},
    "space_weather": {
        "key": ["event_type", "native_id"], "required": [],
        "columns": {"event_type": ["@event_type"], "native_id": ["activityID", "gstID", "flrID", "sepID", "messageID", "#"], "event_time": ["startTime", "beginTime", "peakTime", "eventTime", "messageIssueTime"], "end_time": ["endTime"], "title": ["messageType", "classType", "@event_type"], "status": ["catalog"], "location": ["sourceLocation", "location"]},
    },
    "small_bodies": {
        "key": ["native_id"], "required": ["native_id"], "family": "earth", "flags": {"is_neo": "neo", "is_pha": "pha"}, "truth": "space",
        "columns": {"native_id": ["spkid", "pdes", "full_name"], "spkid": ["spkid"], "designation": ["pdes", "full_name"], "kind": ["kind"], "orbit_class": ["class"]},
        "numbers": {"absolute_magnitude": "H", "diameter_km": "diameter", "semimajor_axis_au": "a", "eccentricity": "e", "inclination_deg": "i", "moid_au": "moid"},
    },
    "close_approaches": {
        "key": ["designation", "body", "approach_time", "orbit_id"], "required": [], "family": "earth",
        "columns": {"designation": ["des", "fullname", "=unknown"], "body": ["body", "@body", "=Earth"], "approach_time": ["cd", "jd", "=unknown"], "orbit_id": ["orbit_id"], "full_name": ["fullname"]},
        "numbers": {"distance_au": "dist", "distance_min_au": "dist_min", "distance_max_au": "dist_max", "relative_velocity_km_s": "v_rel", "absolute_magnitude": "h"},
    },
    "exoplanets": {
        "key": ["table_name", "planet_name", "host_name"], "required": [], "family": "earth",
        "columns": {"table_name": ["@table"], "planet_name": ["pl_name", "toi", "#"], "host_name": ["hostname", "tic_id"], "discovery_method": ["discoverymethod"]},
        "numbers": {"discovery_year": "disc_year", "orbital_period_days": "pl_orbper", "radius_earth": "pl_rade", "mass_earth": "pl_masse", "stellar_temperature_k": "st_teff", "distance_pc": "sy_dist"},
    },
    "archive_items": {
        "key": ["identifier"], "required": ["identifier"], "lists": {"creators": "creator", "collections": "collection", "subjects": "subject"},
        "columns": {"identifier": ["identifier"], "title": ["title"], "mediatype": ["mediatype"], "item_date": ["date"], "description": ["description"], "metadata_sha256": ["#"]},
    },
    "archive_item_versions": {"key": ["identifier", "metadata_sha256"], "required": ["identifier"], "columns": {"identifier": ["identifier"], "metadata_sha256": ["#"]}},
    "archive_files": {
        "key": ["identifier", "file_name"], "children_of": ["identifier"], "required": ["file_name"], "flags": {"private": "private"}, "truth": "archive", "digits": {"size_bytes": "size"},
        "columns": {"identifier": ["@identifier", "identifier"], "file_name": ["name"], "format": ["format"], "md5": ["md5"], "sha1": ["sha1"]},
    },
    "wayback_captures": {
        "key": ["target_url", "timestamp", "original_url"], "keep": ["mimetype", "status_code", "digest", "length_bytes"], "required": ["timestamp"], "digits": {"length_bytes": "length"},
        "columns": {"target_url": ["@target_url", "target"], "timestamp": ["timestamp"], "original_url": ["original", "@target_url", "target"], "mimetype": ["mimetype"], "status_code": ["statuscode"], "digest": ["digest"], "replay_url": ["url"]},
        "built": {"replay_url": "concat('https://web.archive.org/web/', timestamp, '/', original_url)"},
    },
}

_FIELDS = "_fields"


def _field(path: str) -> Column:
    """A field, or one within an object; object keys with dots do not occur."""
    head, _, rest = path.partition(".")
    held = F.try_element_at(_FIELDS, F.lit(head))
    return F.get_json_object(held, f"$['{rest}']") if rest else held


def _text(value: Column) -> Column:
    plain = F.when(value.startswith("{") | value.startswith("["), derive.json_text(value)).otherwise(value)
    return F.nullif(F.trim(plain), F.lit(""))


def _canonical(fields: Column) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def _chosen(paths: list[str], settings: dict) -> Column:
    """The first of the paths that has a text."""

    def one(path: str) -> Column:
        if path == "#":
            return F.sha2(_canonical(_FIELDS), 256)
        if path.startswith("="):
            return F.lit(path[1:])
        if path.startswith("@"):
            return F.lit(settings.get(path[1:])).cast("string")
        return _text(_field(path))

    return F.coalesce(*map(one, paths))


def _dimensions(spec: dict, metrics: list[str]) -> Column | None:
    """What tells observations of one place and time apart, as JSON; or None."""
    if only := spec.get("only"):
        own = F.map_filter(_FIELDS, lambda k, v: k.isin(*only) & v.isNotNull() & (v != ""))
        given = F.coalesce(F.from_json(_field(spec["within"]), "map<string,string>"), F.create_map().cast("map<string,string>"))
        return _canonical(F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(own, k)), own))
    if "without" in spec:
        suffix = spec.get("without_suffix")
        kept = F.map_filter(_FIELDS, lambda k, v: ~k.isin(*spec["without"], *metrics) & (~k.endswith(suffix) if suffix else F.lit(True)))
        return _canonical(kept)
    return None


def normalised(records: DataFrame, name: str, metrics: list[str] | None = None, order: str = "landed_at", record: str = "record", version: str | None = None, **settings) -> DataFrame:
    """The table of specification ``name`` from ``records``, which have a JSON text and the time it landed.

    ``metrics`` are the requested fields where each is an observation of its own. Of records that share a key, one with
    the latest ``order`` stays; ``order`` should be unique, else the greatest columns among the latest stay. With ``version``,
    a column that tells which fetch of its parent a child row came with, only those of the parent's latest fetch stay.
    """
    spec, metrics = SPECS[name], list(metrics or [])
    if spec.get("wide") and not metrics:
        raise ValueError(f"{name} needs metrics")
    # exploded, so that filters of columns stay above it: pushed below, each of their fields parses the record again
    parsed = F.explode(F.array(F.from_json(record, "map<string,string>")))
    rows = records.select(F.col(order).alias("_order"), F.col(version or order).alias("_version"), parsed.alias("_fields")).where("_fields IS NOT NULL")
    columns = {c: _chosen(paths, settings) for c, paths in spec["columns"].items()}
    if spec.get("wide"):
        asked = [m for m in metrics if m.lower() not in spec.get("never_metrics", ()) and m not in spec.get("without", ())]
        rows = rows.withColumn("metric_code", F.explode(F.array(*map(F.lit, asked)).cast("array<string>"))).where(F.map_contains_key("_fields", F.col("metric_code")))
        columns["metric_code"], value = F.col("metric_code"), F.try_element_at(_FIELDS, F.col("metric_code"))
        if suffix := spec.get("unit_suffix"):
            columns["unit"] = _text(F.try_element_at(_FIELDS, F.concat("metric_code", F.lit(suffix))))
    elif "value" in spec:  # the first field that is there, even if it is null
        value = reduce(lambda rest, path: F.when(F.map_contains_key("_fields", F.lit(path)), _field(path)).otherwise(rest), reversed(spec["value"][:-1]), _field(spec["value"][-1]))
    if spec.get("wide") or "value" in spec:
        columns["value_numeric"] = derive.numeric_value(value, spec["family"])
        columns["value_text"] = F.when(columns["value_numeric"].isNull(), _text(value))
    if (dimensions := _dimensions(spec, metrics)) is not None:
        columns[spec.get("dimensions", "dimensions")] = dimensions
    for column, field in spec.get("numbers", {}).items():
        columns[column] = derive.numeric_value(_field(field), spec["family"])
    for column, field in spec.get("flags", {}).items():
        columns[column] = derive.truthy(_field(field), spec["truth"])
    for column, field in spec.get("digits", {}).items():
        columns[column] = F.when(_field(field).rlike("^[0-9]+$"), _field(field).try_cast("long"))
    for column, field in spec.get("lists", {}).items():
        held = _field(field)
        items = F.when(held.startswith("["), F.from_json(held, "array<string>")).otherwise(F.array(held))
        columns[column] = F.to_json(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))
    for column, named in spec.get("present", {}).items():
        has = {kind: _text(_field(field)).isNotNull() for kind, field in named.items()}
        one = F.coalesce(*(F.when(there, kind) for kind, there in has.items()), F.lit("unknown"))
        columns[column] = F.when(reduce(Column.__and__, has.values()), "both").otherwise(one)
    rows = rows.select("_order", "_version", *(c.alias(n) for n, c in columns.items()))
    for column in spec["required"]:
        rows = rows.where(F.col(column).isNotNull())
    for column, never in spec.get("never", {}).items():
        rows = rows.where(F.col(column) != never)
    for column, built in spec.get("built", {}).items():
        rows = rows.withColumn(column, F.coalesce(column, F.expr(built)))
    key, rest = spec["key"], [c for c in columns if c not in spec["key"]]
    seen = [F.min("_order").alias("first_seen_at"), F.max("_order").alias("fetched_at")]
    if not rest:
        return rows.groupBy(*key).agg(*seen)
    last = F.max(F.struct("_order", F.struct(*rest).alias("rest"))).alias("last")
    kept = [F.max(F.when(F.col(c).isNotNull(), F.struct("_order", c)))[c].alias(f"_{c}") for c in spec.get("keep", [])]
    children = spec.get("children_of") if version else None
    if children:  # few fetches a parent
        latest = rows.groupBy(*children).agg(F.max("_version").alias("_latest"))
        kept.append(F.max("_version").alias("_version"))
    found = rows.groupBy(*key).agg(last, *kept, *seen)
    if children:
        found = found.join(latest, children).where("_version = _latest")
    found = found.select(*key, *(f"_{c}" for c in spec.get("keep", [])), "last.rest.*", "first_seen_at", "fetched_at")
    return found.select(*(F.col(f"_{c}").alias(c) if c in spec.get("keep", []) else F.col(c) for c in (*key, *rest, "first_seen_at", "fetched_at")))
