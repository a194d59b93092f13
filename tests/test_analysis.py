from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from affinity import cli
from affinity.errors import ParseError
from affinity.operators import network, sections, temporal
from affinity.operators.components import connected_components
from affinity.plans import report
from affinity.plans.analysis import analyze, analyze_bytes, analyze_path
from affinity.settings import Settings
from affinity.sources import export
from affinity.sources.synth import generate, write_sample
from affinity.streaming import sessions, windowed_counts

HEADER = "First Name,Last Name,URL,Email Address,Company,Position,Connected On\n"
MINIMAL = 'Notes:\n"Some, words about it"\n\n' + HEADER + 'Ann,Ay,u1,,"Acme, Inc.","Engineer, Senior",15 Mar 2022\nBob,Be,u2,,Acme,VP of Sales,"Mar 16, 2022"\nCy,Ce,u3,,Other LLC,Nurse,17 Mar 2022\nDi,De,,,,,\n,,,,Ghost,,\n'


def saved(tmp_path, data, name="f.csv"):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_minimal_export(spark, tmp_path):
    df, r = export.read_export(spark, saved(tmp_path, MINIMAL))
    assert (r.header_row_index, r.rows_scanned, r.rows_parsed, r.rows_skipped, r.unparsed_dates) == (2, 5, 4, 1, 1)
    assert r.completeness["company"] == 0.75
    assert [(x["row_idx"], x["company"], x["position"]) for x in df.orderBy("row_idx").collect()] == [(0, "Acme", "Engineer, Senior"), (1, "Acme", "VP of Sales"), (2, "Other", "Nurse"), (3, "", "")]
    assert sections.entity_resolution(df).first()[:3] == (3, 2, 1)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    data = (HEADER + "José,Ñuñez,,,Café,Señor,1 Jan 2020\n").encode(encoding)
    df, r = export.read_export(spark, saved(tmp_path, data))
    assert df.first()["first_name"] == "José"
    assert bool(r.warnings) == (encoding in ("cp1252", "latin-1"))


def test_undefined_byte_is_latin1(spark, tmp_path):
    assert export.detect_encoding(spark, saved(tmp_path, b"a\x9d\xe9")) == "latin-1"
    assert export.detect_encoding(spark, saved(tmp_path, b"a\x93\xe9", "g.csv")) == "cp1252"


@pytest.mark.parametrize("data", ["a,b,c\n1,2,3\n", "", HEADER, "x\n" * 40 + HEADER + "A,B,,,,,\n"])
def test_unusable_files(spark, tmp_path, data):
    with pytest.raises(ParseError):
        export.read_export(spark, saved(tmp_path, data))


def test_too_large(spark, tmp_path):
    with pytest.raises(ParseError):
        export.read_export(spark, saved(tmp_path, MINIMAL), max_bytes=10)


def test_other_headers(spark, tmp_path):
    df, r = export.read_export(spark, saved(tmp_path, " FIRST ,Last,Title,Organization,Connected  Date\nA,B,Dean,Org,2020-01-02\n"))
    assert tuple(df.select("position", "company", "connected_on").first()) == ("Dean", "Org", dt.date(2020, 1, 2))


def test_several_files_and_wide_rows(spark, tmp_path):
    wide = "First,Last,Title," + ",".join(f"x{k}" for k in range(100)) + ",Organization\n"
    saved(tmp_path, HEADER + "A,B,,,Acme,Dean,1 Jan 2020\n", "a.csv")
    saved(tmp_path, wide + "C,D,Nurse," + "," * 100 + "Other\n", "b.csv")
    df, r = export.read_export(spark, str(tmp_path))
    assert [(x["first_name"], x["company"], x["position"]) for x in df.orderBy("row_idx").collect()] == [("A", "Acme", "Dean"), ("C", "Other", "Nurse")]
    assert (r.rows_parsed, r.unparsed_dates) == (2, 1)
    assert [x["name"] for x in export.iter_names(df).collect()] == ["A B", "C D"]


def test_settings():
    s = Settings.from_env({"AFFINITY_LOG_LEVEL": "info", "AFFINITY_REDACT": "yes", "AFFINITY_MAX_UPLOAD_MB": "2", "AFFINITY_MAX_GRAPH_NODES": "many"})
    assert (s.log_level, s.redact, s.max_upload_bytes, s.max_graph_nodes, s.log_json) == ("INFO", True, 2 << 20, 6000, False)


def test_package_offers_what_it_names():
    import affinity

    assert all(getattr(affinity, name) is not None for name in affinity.__all__) and len(affinity.__all__) >= 25
    with pytest.raises(AttributeError):
        affinity.nothing


def test_employer_pairs_split_months(spark, monkeypatch):
    monkeypatch.setattr(network, "MONTH_PART", 2)
    rows = [("A", "B", f"E{k % 7}", "", f"{1 + k % 28} {m} 2020") for m in ("Jan", "Feb", "Mar") for k in range(14) if (k % 7, m) not in ((6, "Jan"), (6, "Feb"))]
    df = people(spark, rows)
    got = {(r["source"], r["target"]): r["weight"] for r in network.cooccurrence_edges(df, sections.company_counts(df)).collect()}
    assert got == {(f"E{a}", f"E{b}"): 3 for b in range(6) for a in range(b)}


def test_bytes(spark):
    doc = analyze_bytes(spark, MINIMAL.encode(), include_graph=False)
    assert doc["overview"]["connections"] == 4 and "graph" not in doc


def people(spark, rows):
    return export.from_rows(spark, [dict(zip(("first_name", "last_name", "company_raw", "position_raw", "connected_on_raw"), r)) for r in rows])


def test_degenerate_documents(spark):
    doc = analyze(people(spark, [("A", "B", "Acme", "Engineer", "1 Jan 2020")]))
    assert doc["companies"]["available"] and not doc["temporal"]["available"] and not doc["eras"]["available"]
    doc = analyze(people(spark, [("A", "B", "", "", ""), ("C", "D", "", "", "")]))
    assert not doc["companies"]["available"] and not doc["structure"]["company_cooccurrence"]["available"]


def test_document_is_whole_and_repeats(spark, tmp_path):
    path = write_sample(spark, str(tmp_path / "s.csv"), 200, 7)
    doc = analyze_path(spark, path, redact=True)
    assert doc["overview"]["connections"] == 200 and doc["data_quality"]["ingest"]["rows_skipped"] == 0
    assert sum(e["count"] for e in doc["eras"]["eras"]) == doc["overview"]["with_date"]
    assert sum(r["count"] for r in doc["composition"]["seniority"]["distribution"]) == 200
    assert sum(m["count"] for m in doc["temporal"]["monthly"]) == doc["overview"]["with_date"]
    assert all(n["url"] == "" and n["label"].endswith(".") for n in doc["graph"]["nodes"] if n["kind"] == "person")
    assert "email" not in json.dumps(doc["graph"])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = analyze_path(spark, path, redact=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for d in (doc, again):
        d.pop("runtime_ms")
    assert doc == again
    text = report.markdown(doc, "Title")
    assert text.startswith("# Title") and "## Eras" in text and "Given" not in text
    assert len(report.summary(doc).splitlines()) <= 9


def test_payload_modes(spark):
    df = people(spark, [("A", "B", "Acme", "Engineer", "1 Jan 2020"), ("C", "D", "Acme", "Nurse", ""), ("E", "F", "", "", "2 Feb 2021")])
    for mode, hubs in (("company", 1), ("year", 3), ("function", 3), ("none", 0), ("odd", 1)):
        nodes, edges = network.graph_payload(df, mode)
        assert nodes.filter("kind = 'hub'").count() == hubs, mode
    assert network.graph_payload(df, max_nodes=2)[0].filter("kind = 'person'").count() == 2


def test_eras_fold(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(8)] + [dt.date(2020, 6, 1)] + [dt.date(2020, 9, 1) + dt.timedelta(days=k) for k in range(8)] + [dt.date(2021, 3, 1)]
    df = spark.createDataFrame([(d, 1) for d in days], "day date, n long")
    got = {r["day"]: r["era"] for r in temporal.era_days(df).collect()}
    # a lone day after a gap stays with the next era until that is large enough; the last lone day goes back
    assert got[days[0]] == 0 and got[days[8]] == 1 and got[days[9]] == 1 and got[days[-1]] == 1
    assert temporal.era_days(df.limit(5)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")] + [(f"n{k}", f"n{k + 1}") for k in range(100, 140)], "source string, target string")
    sizes = sorted(r["count"] for r in connected_components(edges).groupBy("component").count().collect())
    assert sizes == [2, 3, 41]
    assert connected_components(edges.limit(0)).count() == 0


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "s.csv")
    assert cli.main(["sample", "--out", path, "--count", "60", "--seed", "3"], spark) == 0
    assert cli.main(["analyze", path, "--no-graph"], spark) == 0
    assert "graph" not in json.loads(capsys.readouterr().out)
    assert cli.main(["analyze", str(tmp_path / "none.csv")], spark) == 2
    assert cli.main(["analyze", saved(tmp_path, "a,b\n1,2\n", "bad.csv")], spark) == 1


def test_sample_is_the_same_for_a_seed(spark):
    a, b = (generate(spark, 50, s).collect() for s in (1, 1))
    assert a == b and a != generate(spark, 50, 2).collect()


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=d), u) for d, u in ((0, 1), (3, 1), (100, 1), (101, 2), (400, 9))]
    spark.createDataFrame(rows, "ts timestamp, user_id long").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    for name, df in (("windows", windowed_counts(stream())), ("sessions", sessions(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("windows").agg(F.sum("count")).first()[0] == 5
    batch = sessions(spark.read.parquet(str(tmp_path / "in")))
    assert sorted((r["user_id"], r["count"]) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1), (9, 1)]
