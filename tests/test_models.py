import os
from pathlib import Path

import pytest
from footfall.config import Limits
from footfall.operators import models as lookups
from footfall.operators.values import StoredValues, displayed_columns, needed_columns
from footfall.sources import dumps, models
from testbed import inputs

WEB = """<?xml version="1.0"?>
<Web><Area id="a1"><Page id="sv1#a1#page1" name="Home"><Inner>
  <IndexUnit id="sv1#page1#dau1" name="List" entity="dm#ent1" displayAttributes="dm#att1  dm#att2">
    <Link id="x#ln1" name="open" to="x#dau2"/><OKLink id="x#ln2" to="x#dau1"/>
  </IndexUnit>
  <DataUnit id="sv1#page1#dau2" name="Card" entity="dm#ent1"/>
  <EntryUnit id="sv1#page1#dau3" name="Form" entity="dm#ent1" displayAttributes="dm#att1"/>
  <GetUnit id="sv1#page1#dau4" name="Session" entity="dm#ent1"/>
  <NoOpContentUnit id="sv1#page1#dau5" name="Text"/>
</Inner></Page></Area><Page id="page2"/></Web>
"""
OTHER = """<Web><MasterPage id="sv1#mpage1" name="Frame"><Link name="nameless"/></MasterPage></Web>"""
DATA = """<Data><Entity id="dm#ent1" name="Thing" table="THING">
  <Attribute id="dm#ent1#att1" name="name" column="NAME"/>
  <Attribute id="dm#ent1#att2" name="brand" column="Brand"/>
  <Attribute id="dm#ent1#att3" name="derived"/>
</Entity><Entity id="dm#ent2" name="Empty" table="EMPTY"/></Data>
"""


@pytest.fixture
def web(folder):
    for name, text in (("one", WEB), ("two", OTHER)):
        with open(os.path.join(folder, f"page{name}.wr"), "w") as file:
            file.write(text)
    return [f"{folder}/page*.wr", f"{folder}/mpage*.wr"]


@pytest.fixture
def data(folder):
    with open(os.path.join(folder, "Properties.wr"), "w") as file:
        file.write(DATA)
    return [f"{folder}/Properties.wr"]


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_pages_at_any_depth(spark, web):
    assert rows(models.read_pages(spark, web), "page_id", "page_name", "kind") == [
        ("mpage1", "Frame", "MasterPage"),
        ("page1", "Home", "Page"),
        ("page2", None, "Page"),
    ]


def test_links_of_all_kinds_with_missing_attributes(spark, web):
    assert rows(models.read_links(spark, web), "link_id", "link_name", "target_unit", "kind") == [
        ("ln1", "open", "dau2", "Link"),
        ("ln2", None, "dau1", "OKLink"),
        (None, "nameless", None, "Link"),
    ]


def test_units_by_group(spark, web):
    assert rows(models.read_units(spark, web), "unit_id", "entity_id", "displayed_attribute") == [
        ("dau1", "dm#ent1", "att1"),
        ("dau1", "dm#ent1", "att2"),
        ("dau2", "dm#ent1", None),
        ("dau3", "dm#ent1", None),
        ("dau4", None, None),
        ("dau5", None, None),
    ]


def test_attributes_without_a_column_drop_out(spark, data):
    assert rows(models.read_attributes(spark, data), "entity_id", "table_db", "attribute_id", "attribute_database_column") == [
        ("dm#ent1", "THING", "att1", "NAME"),
        ("dm#ent1", "THING", "att2", "Brand"),
    ]


def test_files_are_read_once(spark, web):
    for read in (models.read_pages, models.read_links, models.read_units):
        plan = read(spark, web)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("FileScan text") == 1


def test_elements_in_odd_text(spark, folder):
    """Comments, other sections, quotes, line breaks, references and names that only begin alike."""
    text = """<Web><!-- <Page id="no1"/> --><![CDATA[<Page id="no2"/>]]><Pages id="no3"/><PageX/>
<Page
  id='a#p1' name="a &gt; b &amp; 'c' > d / e"
><Page id="p2" name='say "x"' other="no>"  /></Page><Page id="p3" name="&#228;é"></Page><Page/>
<Entity id="e1" name="E" table="T"></Entity><Entity id="e2" name="F" table="T">
<!-- <Attribute id="x" column="X"/> --><Attribute id="e2#a1" name="n" column="N"></Attribute></Entity ></Web>"""
    with open(os.path.join(folder, "odd.wr"), "w") as file:
        file.write(text)
    assert rows(models.read_pages(spark, [f"{folder}/odd.wr"]), "page_id", "page_name") == [
        ("p1", "a > b & 'c' > d / e"), ("p2", 'say "x"'), ("p3", "äé"), (None, None)
    ]
    assert rows(models.read_attributes(spark, [f"{folder}/odd.wr"]), "entity_id", "attribute_id") == [("e2", "a1")]


def test_absent_elements_give_no_rows(spark, data):
    assert models.read_pages(spark, data).count() == 0
    assert models.read_units(spark, data).count() == 0


def test_combined_model_holds_a_repeated_component_once(spark, web, data):
    units = models.read_units(spark, web)
    combined = lookups.combined_model(units.union(units), models.read_attributes(spark, data))
    assert rows(combined, "unit_id", "attribute_id") == [("dau1", "att1"), ("dau1", "att2")]


def write_dump(folder, table, text):
    os.makedirs(f"{folder}/dumps", exist_ok=True)
    with open(f"{folder}/dumps/{table}.csv", "w") as file:
        file.write(text)


def test_dump_values_of_displayed_columns(spark, folder, web, data):
    write_dump(folder, "THING", "OID;NAME;BRAND;OTHER\n1;b;x;y\n1;a;;y\n2;NULL;z;y\nx;c;c;c\n")
    tables = dumps.read_dumps(spark, f"{folder}/dumps", ["THING", "ORDER"])
    assert list(tables) == ["THING"]
    assert tables["THING"].first().table_name == "THING"
    combined = lookups.combined_model(models.read_units(spark, web), models.read_attributes(spark, data))
    names = displayed_columns(tables, combined)
    assert {name: rows for name, (rows, _) in names.items()} == {("THING", "NAME"): 1, ("THING", "BRAND"): 1}
    assert needed_columns(tables, names) == {"THING": ["NAME", "BRAND"]}
    assert needed_columns(tables, [None]) == {"THING": []}
    assert list(displayed_columns({}, combined)) == [None]
    stored = StoredValues(spark, tables, lambda: names, Limits())
    keys = spark.createDataFrame([(o, "THING", c) for o in (1, 2, 3) for c in ("NAME", "BRAND", "OTHER")], ["oid", "value_table", "value_column"])
    lookup = stored.lookup(lambda: keys)
    assert rows(lookup.frame, "oid", "value_table", "value_column", "value") == [
        (1, "THING", "BRAND", "x"),
        (1, "THING", "NAME", "a"),
        (2, "THING", "BRAND", "z"),
        (2, "THING", "NAME", "NULL"),
    ]
    assert stored.is_small and lookup.is_small
    large = StoredValues(spark, tables, lambda: names, Limits(broadcast_rows=0)).lookup(lambda: keys)
    assert not large.is_small and sorted(large.frame.collect()) == sorted(lookup.frame.collect())
    # By the size of the files, without counting.
    assert StoredValues(spark, tables, lambda: names, Limits(broadcast_rows=100), lambda: 100).is_small


def test_large_values_are_joined_without_looking_for_keys(spark, folder):
    """The facts are described once: nothing asks them for their keys before the join."""
    write_dump(folder, "THING", "OID;NAME;BRAND\n1;b;x\n1;a;\n2;NULL;\nx;c;c\n;d;d\n")
    write_dump(folder, "ORDER", "OID;TITLE\n1;t\n3;u\n")
    tables = dumps.read_dumps(spark, f"{folder}/dumps", ["THING", "ORDER"])
    names = [("THING", "NAME"), ("THING", "BRAND"), ("ORDER", "TITLE"), ("ORDER", "OID")]
    keys = [(o, t, c) for o in (1, 2, 3, None) for t in ("THING", "ORDER", None) for c in ("NAME", "BRAND", "TITLE", "OID", None)]
    facts = spark.createDataFrame([(*k, i) for k in keys for i in range(2)], "oid long, value_table string, value_column string, n int")
    small = StoredValues(spark, tables, lambda: names, Limits()).lookup(lambda: facts)
    asked = []
    large = StoredValues(spark, tables, lambda: names, Limits(broadcast_rows=0)).lookup(lambda: asked.append(1))
    columns = ("oid", "value_table", "value_column", "n", "value")
    joined = large.join(facts, "left")
    assert small.is_small and not large.is_small and not asked
    assert sorted(joined.columns) == sorted(columns)
    got, want = (sorted(f.select(*columns).collect(), key=str) for f in (joined, small.join(facts, "left")))
    assert got == want and len(got) == len(keys) * 2
    assert {r.value for r in got} == {"a", "x", "NULL", "t", "u", "1", "3", None}
    with pytest.raises(ValueError):
        large.join(facts, "inner")


def test_lines_are_made_once(spark):
    """No filter on lines is moved below the shuffle of the events they are made of."""
    for made in (inputs.access_lines, inputs.runtime_lines):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression"):]
        assert "date_format" in plan and "date_format" not in below


def test_no_dumps_give_no_values(spark, web, data):
    combined = lookups.combined_model(models.read_units(spark, web), models.read_attributes(spark, data))
    stored = StoredValues(spark, {}, lambda: [None], Limits())
    assert stored.lookup(lambda: combined.limit(0)).frame.count() == 0


def test_no_file_of_the_model_is_large(spark, folder, monkeypatch):
    """A file is one text of one task, so a larger model is more files; it reads the same."""

    def links(name):
        inputs.write_model(spark, "/root/testdata/sf0.001", f"{folder}/{name}")
        return sorted(map(tuple, models.read_links(spark, [f"{folder}/{name}/web/links"]).collect()))

    whole = links("whole")
    monkeypatch.setattr(inputs, "MODEL_ROWS", 50)
    assert links("parts") == whole
    files = list(Path(folder, "parts/web/links").glob("part-*"))
    assert len(files) == -(-len(whole) // 50) and all(f.read_text().count("<Area>") <= 50 for f in files)
