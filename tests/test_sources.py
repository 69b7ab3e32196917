import decimal

import pytest
from helpers import rows
from pyspark.sql import types as T

from tessera.sources import csv

SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("PRV", T.StringType()),
        T.StructField("AMT", T.DecimalType(12, 2)),
    ]
)


@pytest.fixture
def write(tmp_path):
    def _write(text):
        path = tmp_path / "extract.csv"
        path.write_text(text)
        return str(path)

    return _write


def test_missing_tokens_and_decimal_comma(spark, write):
    path = write('ID;PRV;AMT\n1;NA;1,50\n2;;2\n3;"a;b";-1000,25\n4;"";\n')
    money = [decimal.Decimal(x) for x in ("1.50", "2.00", "-1000.25")]
    default = rows(csv.read_european_csv(spark, path, SCHEMA))
    assert default == [(1, None, money[0]), (2, None, money[1]), (3, "a;b", money[2]), (4, None, None)]
    address = rows(csv.read_european_csv(spark, path, SCHEMA, missing=None))
    assert [r[1] for r in address] == ["NA", None, "a;b", None]


def test_columns_are_found_by_name(spark, write):
    path = write("EXTRA;AMT;PRV;ID\nx;1,5;MI;7\n")
    assert rows(csv.read_european_csv(spark, path, SCHEMA)) == [(7, "MI", decimal.Decimal("1.50"))]
    with pytest.raises(ValueError):
        csv.read_european_csv(spark, write("ID;PRV\n1;MI\n"), SCHEMA)


def test_address_keeps_leading_zeros_and_na_province(spark, write):
    path = write("ID_ADDRESS;CAP;PRV;REGION\n1;00184;NA;CAMPANIA\n2;;RM;\n")
    assert rows(csv.read_address(spark, path)) == [
        (1, "00184", "NA", "CAMPANIA"),
        (2, None, "RM", None),
    ]


def test_ticket_times(spark, write):
    path = write(
        "ID_SCONTRINO;ID_CLI;ID_ARTICOLO;COD_REPARTO;DIREZIONE;IMPORTO_LORDO;SCONTO;DATETIME\n"
        "1;2;3;4;1;12,30;0;2018-05-04T181359\n1;2;3;4;-1;-12,30;0;later\n"
    )
    found = csv.read_ticket(spark, path).select(
        "COD_REPARTO", "IMPORTO_LORDO", "TIC_HOUR", "TIC_DATE"
    )
    texts = [tuple(None if v is None else str(v) for v in r) for r in found.collect()]
    assert texts == [("4", "12.30", "18", "2018-05-04"), ("4", "-12.30", None, None)]


def test_event_times(spark, write):
    path = write(
        "ID_EVENT;ID_CLI;ID_CAMP;ID_DELIVERY;TYP_EVENT;EVENT_DATE\n"
        "1;2;3;4;S;2018-12-31T23:59:59\n"
    )
    found = csv.read_event(spark, path).select("EVENT_HOUR", "EVENT_DATE").collect()
    assert [(h, str(d)) for h, d in found] == [(23, "2018-12-31")]


def test_other_extracts(spark, write):
    path = write("ID_CLI;ID_FID;COD_FID;TYP_CLI_FID;STATUS_FID;ID_NEG;DT_ACTIVE\n1;2;GOLD;1;1;9;2018-01-02\n")
    assert str(csv.read_fidelity(spark, path).collect()[0]["DT_ACTIVE"]) == "2018-01-02"
    path = write("ID_CLI;EMAIL_PROVIDER;W_PHONE;ID_ADDRESS;TYP_CLI_ACCOUNT;TYP_JOB\n1;NA;1;2;4;\n")
    assert rows(csv.read_account(spark, path)) == [(1, None, "1", 2, "4", None)]
    path = write("ID_CLI;FLAG_PRIVACY_1;FLAG_PRIVACY_2;FLAG_DIRECT_MKT\n1;1;0;1\n")
    assert rows(csv.read_privacy(spark, path)) == [(1, "1", "0", "1")]
    path = write("ID_CAMP;TYP_CAMP;CHANNEL_CAMP\n1;PROMO;EMAIL\n")
    assert rows(csv.read_campaign(spark, path)) == [(1, "PROMO", "EMAIL")]


@pytest.fixture
def extract(tmp_path):
    """Two files whose columns are in another order, with broken lines."""
    (tmp_path / "a.csv").write_text('ID;PRV;AMT\n1;MI;1,50\n2;RM;x7\n3;"a;b"\n4;TO;1,5;more\ny;NA;2\nz;;w\n\n5;"";\n')
    (tmp_path / "b.csv").write_text('AMT;EXTRA;ID;PRV\n2,25;q;8;NA\n"-1000,25";"x;""y";9;MI\n3,x5;;10;TO\n')
    (tmp_path / "empty.csv").write_text("")
    return tmp_path


def test_bad_lines_are_set_apart(spark, extract):
    found = csv.read_checked_csv(spark, str(extract), SCHEMA)
    good = [(r["ID"], r["PRV"], None if r["AMT"] is None else str(r["AMT"])) for r in found.rows.collect()]
    assert sorted(good) == [(1, "MI", "1.50"), (5, None, None), (8, None, "2.25"), (9, "MI", "-1000.25")]
    bad = sorted((r["FILE"].rsplit("/", 1)[1], r["LINE"], r["REASON"]) for r in found.rejected.collect())
    assert bad == [
        ("a.csv", "2;RM;x7", "AMT is no decimal(12,2): x7"),
        ("a.csv", '3;"a;b"', "2 fields, the header has 3"),
        ("a.csv", "4;TO;1,5;more", "4 fields, the header has 3"),
        ("a.csv", "y;NA;2", "ID is no bigint: y"),
        ("a.csv", "z;;w", "ID is no bigint: z; AMT is no decimal(12,2): w"),
        ("b.csv", "3,x5;;10;TO", "AMT is no decimal(12,2): 3,x5"),
    ]
    counts = [tuple(r)[1:] for r in csv.rejected_counts(found.rejected).collect()]
    assert ("AMT is no decimal(12,2)", 1) in counts and sum(c[1] for c in counts) == 6


def test_bad_lines_are_counted_whatever_is_selected(spark, extract):
    found = csv.read_checked_csv(spark, str(extract), SCHEMA)
    assert found.rejected.select("FILE").count() == found.rejected.count() == 6
    assert found.rows.select("PRV").count() == found.rows.count() == 4


def test_columns_of_each_file_are_found_by_name(spark, extract):
    found = csv.read_european_csv(spark, str(extract), SCHEMA)
    assert {(r["ID"], r["PRV"]) for r in found.collect()} >= {(1, "MI"), (8, None), (9, "MI"), (10, "TO")}
    (extract / "c.csv").write_text("ID;AMT\n1;2\n")
    with pytest.raises(ValueError, match="PRV"):
        csv.read_european_csv(spark, str(extract), SCHEMA)
    with pytest.raises(ValueError, match="no file"):
        csv.read_european_csv(spark, str(extract / "empty.csv"), SCHEMA)


def test_files_that_are_named(spark, extract):
    found = csv.read_checked_csv(spark, [str(extract / "b.csv")], SCHEMA, missing=None)
    assert sorted(r["PRV"] for r in found.rows.collect()) == ["MI", "NA"]
    assert found.rejected.count() == 1
