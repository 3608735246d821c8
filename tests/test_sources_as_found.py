"""Services, names and types as they are found in the wild."""

import json
import re

from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from landspan.operators import tables
from landspan.sources import csv, features, files, shapefile, wfs


def capped_features(most, total=7, lost=0):
    """A service that counts ``total`` rows and gives at most ``most`` a page."""
    def fetch(url):
        if "returnCountOnly" in url:
            return json.dumps({"count": total})
        start, asked = (int(re.search(rf"{key}=(\d+)", url).group(1)) for key in ("resultOffset", "resultRecordCount"))
        rows = range(start, min(start + min(asked, most), total - lost))
        return json.dumps({"features": [{"properties": {"n": n}, "geometry": None} for n in rows]})

    return fetch


@pytest.mark.parametrize("most", [1, 3, 7, 50])
def test_short_pages_lose_nothing(spark, most):
    got = features.fetch_features(spark, "http://x", capped_features(most), page_size=5)
    assert sorted(r["n"] for r in got.collect()) == list(range(7))


def test_missing_features_raise(spark):
    with pytest.raises(ValueError, match="counts 7 features but its pages hold 6"):
        features.fetch_features(spark, "http://x", capped_features(3, lost=1), page_size=5)


def test_short_wfs_pages_lose_nothing(spark):
    def fetch(url):
        if "resultType=hits" in url:
            return '<wfs:FeatureCollection numberMatched="5"/>'
        start, asked = (int(re.search(rf"{key}=(\d+)", url).group(1)) for key in ("startIndex", "[^e]count"))
        rows = "".join(f"<wfs:member><a:site><a:n>{n}</a:n></a:site></wfs:member>"
                       for n in range(start, min(start + min(asked, 2), 5)))
        return ('<wfs:FeatureCollection xmlns:wfs="http://w" xmlns:a="http://a" xmlns:gml="http://g">'
                f"{rows}</wfs:FeatureCollection>")

    got = wfs.fetch_wfs(spark, "http://x", "a:site", fetch, page_size=4)
    assert got.count() == 5


def test_listing_matches_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.tiff", "b.TIF", "c.tif", "d.txt", "other.tif.bak"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda path: sorted(
        r["path"].rsplit("/", 1)[1] for r in files.listing(spark, str(path), "tif", "tiff").collect())
    assert names(tmp_path) == ["a.tiff", "b.TIF", "c.tif"]
    assert names(tmp_path / "d.txt") == ["d.txt"]
    assert names(f"file://{tmp_path}/a.tiff") == ["a.tiff"]


def test_shape_types(spark):
    assert [shapefile._shape_kind(c) for c in (0, 1, 13, 25, 28)] == [
        None, "Point", "LineString", "Polygon", "MultiPoint"]
    for code in (2, 31, 33, 38):
        with pytest.raises(ValueError):
            shapefile._shape_kind(code)
    assert shapefile._beside("/x/A.SHX", "dbf") == "/x/A.DBF"


def test_journal_refuses_nulls(spark):
    table = "journal_nulls.runs"
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.JOURNAL_SCHEMA.fields])
    with pytest.raises(ValueError):
        tables.append_journal(row, table)
    assert spark.table(table).count() == 0


def test_run_records_fill_the_journal(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS journal_records")
    runs = spark.sql("SELECT 'extra' AS hostname, t AS completed, t - INTERVAL 1 HOUR AS started, id AS node_id "
                     "FROM VALUES ('a', TIMESTAMP '2024-03-01'), ('b', TIMESTAMP '2024-03-02') AS v(id, t)")
    records = tables.run_records(runs, "loader", "h1", "2.0")
    assert records.columns == tables.JOURNAL_SCHEMA.names
    tables.append_journal(records, "journal_records.runs")
    tables.append_journal(tables.run_records(runs.limit(0), "loader", "h1", "2.0", "abc"), "journal_records.runs")
    found = spark.table("journal_records.runs").orderBy("node_id").collect()
    assert [(r["node_id"], r["hostname"], r["engine_version"], r["repo_revision"]) for r in found] == [
        ("a", "h1", "2.0", None), ("b", "h1", "2.0", None)]


def test_wfs_northing_first_and_heights(spark, tmp_path):
    shapes = [
        '<gml:Point srsName="urn:ogc:def:crs:EPSG::2193"><gml:pos>5400000 1600000</gml:pos></gml:Point>',
        '<gml:LineString srsName="EPSG:2193" srsDimension="3"><gml:posList>1 2 3 4 5 6</gml:posList>'
        "</gml:LineString>",
        '<gml:LineString srsName="EPSG:2193"><gml:posList> </gml:posList></gml:LineString>',
    ]
    (tmp_path / "a.xml").write_text(
        '<wfs:FeatureCollection xmlns:wfs="http://w" xmlns:a="http://a" xmlns:gml="http://g">'
        + "".join(f"<wfs:member><a:site><a:n>{n}</a:n><a:g>{shape}</a:g></a:site></wfs:member>"
                  for n, shape in enumerate(shapes)) + "</wfs:FeatureCollection>")
    got = {r["n"]: [[tuple(v) for v in ring] for part in r["g"]["parts"] for ring in part]
           for r in wfs.read_wfs(spark, str(tmp_path), "a:site").collect() if r["g"]}
    assert got[0] == [[(1600000.0, 5400000.0, None)]]
    assert got[1] == [[(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]]
    assert got.get(2, [[]]) == [[]]


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note\n1;"two\nlines"\n2;x\n', encoding="latin-1")
    rows = csv.read_csv(spark, str(tmp_path / "a.csv"), separator=";", multi_line=True,
                        encoding="iso-8859-1").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "x")]


def test_pages_by_id_lose_nothing_when_the_layer_changes(spark, tmp_path):
    """Each request sees the layer with other rows deleted and inserted; ids have gaps."""
    ids = [3 * i + 5 for i in range(40)] + [100_000 + i for i in range(10)]

    def fetch(url):
        query = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        late = [n for n in range(5, 20) if n not in ids]  # come while pages are read
        if "returnCountOnly" in query:
            return json.dumps({"count": len(ids)})
        if "outStatistics" in query:
            return json.dumps({"features": [{"attributes": {"min": ids[0], "max": ids[-1]}}]})
        after, upto = map(int, re.findall(r"\d+", query["where"]))
        rows = sorted(n for n in [*ids, *late] if after < n <= upto)[:min(int(query["resultRecordCount"]), 4)]
        return json.dumps({"features": [{"type": "Feature", "properties": {"OID": n, "late": n in late},
                                         "geometry": {"type": "Point", "coordinates": [n, 0]}} for n in rows]})

    got = features.fetch_features(spark, "https://example.org/layer/0", fetch, page_size=6, id_field="OID").collect()
    assert sorted(r["OID"] for r in got if not r["late"]) == ids
    assert len(got) == len({r["OID"] for r in got})
