"""Provider specifications on literal records."""

import json

import pytest

from attesta.sources.providers import SPECS, normalised


def landed(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "landed_at int, record string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_country_falls_back_and_incomplete_rows_go(spark):
    records = landed(spark, {"countryiso3code": "", "country": {"id": "FR", "value": "France"}, "date": "2020", "value": 1.5}, {"countryiso3code": "DEU", "indicator": {"id": "X"}, "date": "2020", "value": "n.a."}, {"date": "2020", "value": 2})
    found = normalised(records, "world_bank_observations", indicator="GDP")
    assert rows(found, "country_code", "indicator_code", "value_numeric", "value_text") == [("DEU", "X", None, "n.a."), ("FR", "GDP", 1.5, None)]


def test_the_record_landed_last_stays_with_first_sight(spark):
    records = landed(spark, {"id": "a", "name": "old", "unit": "kg"}, {"id": "b", "name": "other"}, {"id": "a", "name": "new"})
    assert rows(normalised(records, "world_bank_indicators"), "indicator_code", "name", "unit", "first_seen_at", "fetched_at") == [("a", "new", None, 0, 2), ("b", "other", None, 1, 1)]


def test_sdg_dimensions_fold_into_one_map(spark):
    records = landed(spark, {"series": "S", "areaCode": 4, "year": 2019, "sex": "F", "age": "", "dimensions": {"sex": "M", "unit": "n"}, "value": "7"}, {"series": "S", "areaCode": 4, "year": 2019, "value": None, "valueNumeric": 8})
    assert rows(normalised(records, "un_sdg_observations"), "series_code", "geo_area_code", "period", "nature", "dimensions", "value_numeric") == [("S", "4", "2019", "", '{"sex":"F","unit":"n"}', 7.0), ("S", "4", "2019", "", "{}", None)]


def test_census_rows_become_one_row_a_variable(spark):
    records = landed(spark, {"NAME": "A", "state": "01", "B1": "1,200", "B2": "(NA)"})
    found = normalised(records, "census_observations", metrics=["NAME", "B1", "B2", "B9"], dataset="acs", year=2022)
    assert rows(found, "metric_code", "geography", "geography_name", "value_numeric", "value_text") == [("B1", '{"state":"01"}', "A", 1200.0, None), ("B2", '{"state":"01"}', "A", None, "(NA)")]


def test_eia_units_belong_to_their_metric(spark):
    records = landed(spark, {"period": "2020", "stateid": "CA", "price": 3, "price-units": "cents", "sales": 9})
    assert rows(normalised(records, "eia_observations", metrics=["price", "sales"], route="r"), "metric_code", "unit", "value_numeric", "dimensions") == [("price", "cents", 3.0, '{"period":"2020","stateid":"CA"}'), ("sales", None, 9.0, '{"period":"2020","stateid":"CA"}')]


def test_tabledap_coordinates_are_no_metrics(spark):
    records = landed(spark, {"time": "t", "station": "s", "latitude": "1.5", "temp": "4", "Depth": "2"})
    assert rows(normalised(records, "erddap_observations", metrics=["time", "latitude", "Depth", "temp"], dataset="d"), "metric_code", "native_id", "value_numeric", "latitude") == [("temp", "s", 4.0, 1.5)]


def test_catalog_kinds_and_the_entry_of_all_datasets(spark):
    records = landed(spark, {"Dataset ID": "allDatasets"}, {"datasetID": "a", "griddap": "x", "tabledap": "y"}, {"dataset_id": "b", "tabledap": "y"}, {"dataset_id": "c"})
    assert rows(normalised(records, "erddap_datasets", server="s"), "dataset_id", "title", "service_kind") == [("a", "a", "both"), ("b", "b", "tabledap"), ("c", "c", "unknown")]


def test_bodies_files_and_captures(spark):
    bodies = normalised(landed(spark, {"spkid": "", "pdes": "P", "neo": "Y", "H": "nan"}, {"name": "none"}), "small_bodies")
    assert rows(bodies, "native_id", "spkid", "is_neo", "is_pha", "absolute_magnitude") == [("P", None, True, False, None)]
    files = normalised(landed(spark, {"name": " f ", "size": "12", "private": "yes"}, {"name": "", "size": "1"}, {"name": "g", "size": "x"}), "archive_files", identifier="i")
    assert rows(files, "file_name", "size_bytes", "private") == [("f", 12, True), ("g", None, False)]
    captures = normalised(landed(spark, {"timestamp": "2020", "digest": "d"}, {"original": "o"}), "wayback_captures", target_url="u")
    assert rows(captures, "timestamp", "original_url", "digest") == [("2020", "u", "d")]


def test_values_of_captures_are_kept_and_files_of_older_fetches_go(spark):
    records = landed(spark, {"timestamp": "2020", "digest": "d", "length": "5", "mimetype": "x"}, {"timestamp": "2020", "statuscode": "200", "length": "-", "mimetype": "y"})
    captures = normalised(records, "wayback_captures", target_url="u")
    assert rows(captures, "mimetype", "status_code", "digest", "length_bytes", "replay_url") == [("y", "200", "d", 5, "https://web.archive.org/web/2020/u")]
    files = landed(spark, {"identifier": "i", "name": "a"}, {"identifier": "i", "name": "b"}, {"identifier": "j", "name": "a"}, {"identifier": "i", "name": "b"}, {"identifier": "i", "name": "c"})
    fetched = files.selectExpr("landed_at", "CASE WHEN landed_at < 3 THEN 1 ELSE 2 END AS fetch", "record")
    assert rows(normalised(fetched, "archive_files", version="fetch"), "identifier", "file_name", "first_seen_at") == [("i", "b", 1), ("i", "c", 4), ("j", "a", 2)]
    items = normalised(landed(spark, {"identifier": "i", "creator": ["a", " ", "b"], "subject": "s"}), "archive_items")
    assert rows(items, "creators", "collections", "subjects") == [('["a","b"]', None, '["s"]')] or rows(items, "creators", "collections", "subjects") == [('["a","b"]', "[]", '["s"]')]


def test_rows_landed_at_once_leave_one(spark):
    records = spark.createDataFrame([(1, '{"series":"S","areaCode":4,"year":1,"value":"438"}'), (1, '{"series":"S","areaCode":4,"year":1,"value":"1499"}')], "landed_at int, record string")
    assert rows(normalised(records, "un_sdg_observations"), "value_numeric") == [(1499.0,)]


def test_equal_records_without_identifier_are_one(spark):
    records = landed(spark, {"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "2"})
    assert rows(normalised(records, "epa_records", table="t"), "table_name", "first_seen_at", "fetched_at") == [("t", 0, 1), ("t", 2, 2)]


@pytest.mark.parametrize("name", sorted(SPECS))
def test_no_records_and_no_objects_give_no_rows_with_the_same_columns(spark, name):
    settings = {"metrics": ["m"]} if SPECS[name].get("wide") else {}
    empty = normalised(landed(spark, None, "no json", "").where("landed_at >= 0"), name, **settings)
    assert set(SPECS[name]["key"]) <= set(empty.columns) and empty.count() == 0


def test_metrics_are_needed_where_fields_are_observations(spark):
    with pytest.raises(ValueError, match="metrics"):
        normalised(landed(spark, {}), "census_observations")


def test_a_record_is_parsed_once(spark):
    landed = spark.range(3).selectExpr("id AS landed_at", "to_json(named_struct('code', id, 'title', concat('t', id))) AS record")
    plan = normalised(landed, "un_sdg_goals")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") == 1
