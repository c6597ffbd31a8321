"""Readers of raw corpus files on small files."""

import json

import pytest

from signflow.sources import corpus, formats


def rows(df, *columns):
    return {r["id"]: tuple(" ".join(r[c]) if c == "signs" else r[c] for c in ("signs", *columns)) for r in df.collect()}


@pytest.fixture
def sides(tmp_path):
    one = [
        {"id": "M-1", "description": "unicorn IV seal", "graphemes": [{"id": "a", "features": [0, 1, 3, 7, 8]}, {"id": "b", "features": [1, 2, 4]}]},
        {"id": "H-2", "description": "Jar", "graphemes": [{"id": "a", "features": [0, 1, 0, 7, 8]}, {"id": "a", "features": [None, 1, 0, 9]}, {"id": "c"}]},
        {"id": "M-1", "description": "unicorn IV seal", "graphemes": [{"id": "a", "features": [0, 1, 3, 7, 8]}, {"id": "b", "features": [1, 2, 4]}]},
        {"id": "X-3", "graphemes": []},
    ]
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps([{"id": "Z-4", "description": "a sealing", "graphemes": [{"id": "b", "features": []}]}]))
    return str(tmp_path / "*.json")


def test_grapheme_json(spark, sides):
    df = formats.read_grapheme_json(spark, sides)
    assert df.count() == 4
    assert rows(df, "site", "object_type", "line_count", "damaged", "reading_direction", "motif", "mean_uncertainty") == {
        "M-1": ("a b", "Mohenjo-daro", "seal", 2, True, "L-R", "unicorn_IV", 3.5),
        "H-2": ("a a c", "Harappa", "pottery", 1, False, "L-R", "Jar", 0.0),
        "Z-4": ("b", "unknown", "seal", 1, False, "L-R", "a", 0.0),
    }
    assert rows(formats.read_grapheme_json(spark, sides, "allograph"))["H-2"] == ("a_7-8 a_9 c",)
    mixed = formats.read_grapheme_json(spark, sides, "hierarchical", 3)
    assert mixed.count() == 4 and rows(mixed)["H-2"] == ("a_7-8 a c",) and rows(mixed)["M-1"] == ("a_7-8 b",)
    with pytest.raises(ValueError):
        formats.read_grapheme_json(spark, sides, "fine")


def test_sql_dump(spark, tmp_path):
    dump = """CREATE TABLE SITE (x);
INSERT INTO SITE (SITEID, NAME) VALUES ("SI1", "Mohenjo-daro"), ("SI2", "A, B");
INSERT INTO SEAL (SEALID, SITEID, MATERIAL, CISI, MUSEUM, WIDTH, HEIGHT, THICKNESS) VALUES
("1", "SI1", "s", "M-1", "", 1, 2, 3), ("2", "SI2", "s", NULL, "m", 1, 2, 3), ("3", "SI9", "s", "null", "m", 1, 2, 3), ("4", "short");
INSERT INTO INSCRIPTION (SEALID, ISCOMPLETE, DIRECTION) VALUES ("1", "N", "L/R"), ("2", "Y", "R/L");
INSERT INTO ICONOGRAPHY(SEALID, DESCRIPTION) VALUES ("1", "Bull1:W"), ("1", "Gaur");
INSERT INTO GLYPHSEQUENCE (SEALID, GLYPHID, IDX) VALUES ("1", "7", 2), ("1", "8", 1), ("2", "7", 1), ("3", "9", 10), ("3", "5", 9), ("5", "5", 0);
"""
    (tmp_path / "dump.sql").write_text(dump)
    assert rows(formats.read_sql_dump(spark, str(tmp_path / "dump.sql")), "site", "damaged", "reading_direction", "motif", "cisi_number") == {
        "S1": ("G8 G7", "Mohenjo-daro", True, "R-L", "Gaur", "M-1"),
        "S2": ("G7", "A, B", False, "L-R", "unknown", "unknown"),
        "S3": ("G5 G9", "SI9", False, "L-R", "unknown", "unknown"),
        "S5": ("G5", "unknown", False, "L-R", "unknown", "unknown"),
    }


def test_positioned_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"textnum": "1001", "sideline": "10", "posnum": 3, "S1": "001", "S2": "*87", "S3": "", "S4": "5"}, {"textnum": 7, "posnum": "0", "S1": "1"}, {"posnum": "2", "S1": "**010", "S2": "2"}]))
    assert rows(formats.read_positioned_json(spark, str(tmp_path / "p.json")), "mean_uncertainty") == {"1001.10": ("MSg1 MSg87", 50.0), "unknown.0": ("MSg10 MSg2", 50.0)}


def test_marked_lines(spark, tmp_path):
    text = '<TEI.2 id="c.1">\n<l n="1" id="x"><w form="lugal-e" lemma="lugal">\n<w form="X" lemma="X"></l><l n="2"><w form="a" lemma="b">q</w> <w form="c" lemma="d"></l>'
    (tmp_path / "a.xml").write_text(text)
    assert rows(formats.read_marked_lines(spark, str(tmp_path / "a.xml")), "site") == {"c.1.L2": ("b d", "c.1")}
    assert rows(formats.read_marked_lines(spark, str(tmp_path / "a.xml"), "form", 1)) == {"c.1.L1": ("lugal-e",), "c.1.L2": ("a c",)}


def test_conllu(spark, tmp_path):
    text = "\n# text\n1\tx\tone\n2-3\tyz\tno\n2\ty\ttwo\r\n\n \n# empty\n1\tq\t_\n\n1\ta\tthree\nbad\n2.1\tb\tno\n\n1\tp\tfour\n2\tr\tfive"
    (tmp_path / "w.conllu").write_text(text, newline="")
    (tmp_path / "w.conllu_parsed").write_text(text)
    assert rows(formats.read_conllu(spark, str(tmp_path / "*")), "site", "object_type") == {"w.S1": ("one two", "w", "literary_sentence"), "w.S3": ("four five", "w", "literary_sentence")}
    assert len(rows(formats.read_conllu(spark, str(tmp_path / "*"), 1))) == 3


def test_poems(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,tamil_text,thinai,work\n1,"“first, (word)!\n12 alone 1234\n7 .",hill,W\n2,,x,y\n3,"a b",,\n')
    assert rows(formats.read_poems(spark, str(tmp_path / "p.csv")), "site", "motif") == {"1.L1": ("first word", "W", "hill"), "1.L2": ("alone 1234", "W", "hill"), "3.L1": ("a b", "unknown", "unknown")}


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_of_many_records_in_many_splits(spark, tmp_path, small_splits):
    n = 90
    (tmp_path / "a.xml").write_text('<TEI.2 id="c.9">' + "".join(f'<l n="{i}">\n<w lemma="x{i}"> <w lemma="y"></l>\n' for i in range(n)) + "</TEI.2>")
    df = formats.read_marked_lines(spark, str(tmp_path / "a.xml"))
    assert rows(df, "site") == {f"c.9.L{i + 1}": (f"x{i} y", "c.9") for i in range(n)}
    (tmp_path / "w.conllu").write_text("\n\n".join(f"# {i}\n1\ta\tp{i}\n2\tb\tq\n3\tc\t_" if i % 7 else f"# none {i}\n1\ta\t_" for i in range(n)))
    want = [i for i in range(n) if i % 7]
    assert rows(formats.read_conllu(spark, str(tmp_path / "w.conllu"))) == {f"w.S{k + 1}": (f"p{i} q",) for k, i in enumerate(want)}
    (tmp_path / "c.csv").write_text("sign_sequence,site\n" + "".join(f"s{i} t,x\n" for i in range(n)))
    got = corpus.read_csv(spark, str(tmp_path / "c.csv"), ordered=True)
    assert {(r["ord"], r["id"], r["signs"][0]) for r in got.collect()} == {(i, f"row{i}", f"s{i}") for i in range(n)}
    assert {r["id"] for r in corpus.read_csv(spark, str(tmp_path / "c.csv")).collect()} == {f"row{i}" for i in range(n)}
    assert spark.read.text(str(tmp_path / "c.csv")).rdd.getNumPartitions() > 2
    for form, columns in corpus.FORMS.items():
        corpus.write_csv(got, str(tmp_path / form), form)
        assert spark.read.option("header", True).csv(str(tmp_path / form)).columns == list(columns)
