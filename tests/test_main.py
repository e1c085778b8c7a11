"""The command line on a site in the usual folder layout."""

import os

from footfall.__main__ import arguments, main, settings_of

WEB = """<Area><Page id="a#page1" name="Home"/><Page id="a#page2" name="List">
<IndexUnit id="a#dau1" name="Box" entity="e1" displayAttributes="e1#att1"/>
<Link id="a#ln1" name="open" to="a#dau1"/></Page></Area>"""
DATA = """<Data><Entity id="e1" name="Thing" table="ORDER"><Attribute id="e1#att1" name="name" column="NAME"/>
</Entity></Data>"""
ACCESS = """10.0.0.1 - - [01/Jan/2024:00:00:07 +0000] "GET /app/page1.do HTTP/1.1" 200 512 s1
10.0.0.1 - - [01/Jan/2024:00:01:07 +0000] "GET /app/page2.do?sp=page1&link=ln1&att1=5 HTTP/1.1" 200 512 s1
"""
RUNTIME = "01 Jan 2024 00:01:07,1  INFO [h]  (c.U) - [s1][page2][dau1][step][t-1] shown {oid=[5]}\n"


def put(base, path, text):
    os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
    with open(f"{base}/{path}", "w") as file:
        file.write(text)


def test_run_and_reports_only(spark, folder):
    put(folder, "web/site/area/page1.wr", WEB)
    put(folder, "data/Properties.wr", DATA)
    put(folder, "dumps/ORDER.csv", "OID;NAME\n5;Tea\n")
    put(folder, "logs/localhost_1.txt", ACCESS)
    put(folder, "logs/RTX.1", RUNTIME)
    words = [folder, "web", "data", "dumps", "logs", "logs", "out"]
    main(words)
    combined = spark.read.parquet(f"{folder}/out/reports/combined_analysis.parquet")
    got = {r.unit_id: r.asDict() for r in combined.collect()}
    assert set(got) == {"page1: Home", "page2: List", "ln1: open", "dau1: Box"}
    assert got["page1: Home"]["entrance_rate"] == 1.0 and got["page1: Home"]["residence_time"] == 60.0
    assert got["page2: List"]["bounce_rate"] == 1.0
    assert got["ln1: open"]["link_out"] == got["ln1: open"]["link_in"] == 1.0
    assert got["ln1: open"]["top10_clicked_instances"] == ["Tea: 1"]
    assert got["dau1: Box"]["top10_displayed_instances"] == ["Tea: 1"]
    main([*words, "--reports-only"])
    assert spark.read.parquet(f"{folder}/out/reports/combined_analysis.parquet").count() == 4


def test_logs_without_a_usable_line(spark, folder):
    put(folder, "web/site/area/page1.wr", WEB)
    put(folder, "data/Properties.wr", DATA)
    put(folder, "dumps/ORDER.csv", "OID;NAME\n5;Tea\n")
    put(folder, "logs/localhost_1.txt", "junk\n")
    put(folder, "logs/RTX.1", "junk\n")
    main([folder, "web", "data", "dumps", "logs", "logs", "out"])
    assert spark.read.parquet(f"{folder}/out/reports/combined_analysis.parquet").count() == 0
    assert spark.read.parquet(f"{folder}/out/reports/output_link.parquet").columns[-1] == "link_out"


def test_options():
    settings = settings_of(arguments(["b", "w", "d", "u", "a", "r", "o", "--merge-sessions", "--tables", "A", "B"]))
    assert settings.merge_sessions and settings.dump_tables == ("A", "B")
    assert settings.runtime_logs == ("b/r/RTX.*",)
