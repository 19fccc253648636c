from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import pii, text
from tallyforge.operators import statements


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("£1,234.50", "1234.50"), ("(12.00)", "-12.00"), ("-£5.00", "-5.00"), ("$7.10", "7.10"), ("bla k", None), ("", None)])
def test_amounts(spark, raw, want):
    assert one(spark, raw, text.amount) == (D(want) if want else None)


@pytest.mark.parametrize(("raw", "slug"), [("Costa Coffee!", "costa_coffee"), ("  --  ", "merchant"), ("A&B 12", "a_b_12")])
def test_slugs(spark, raw, slug):
    assert one(spark, raw, text.slug) == slug


@pytest.mark.parametrize(("raw", "name", "mid"), [("costa coffee", "Costa Coffee", "costa_coffee"), ("TESCO 123 STORES LEEDS", "Tesco", "tesco"), ("a 1 GBP", "Other", "other"), (None, "Other", "other"), ("supercalifragilistic expialidocious", "Supercalifragilistic Expialidocious", "supercalifragilistic")])
def test_names(spark, raw, name, mid):
    assert one(spark, raw, text.canonical_name) == name
    assert one(spark, raw, text.merchant_id) == mid


def test_json(spark):
    assert one(spark, 'so ```json\n{"a": 1}\n``` and {"b": 2}', text.first_json) == '{"a": 1}'
    assert one(spark, 'x {"b": 2} y', text.first_json) == '{"b": 2}'
    assert one(spark, "none", text.first_json) is None
    assert one(spark, '["a", "b"]', text.json_list) == ["a", "b"]
    assert one(spark, None, text.json_list) == []


def test_credit_fields(spark):
    md = "New balance £1,234.56\nMinimum payment: £25.00\nAPR 19.9%\nPayment due date 14 Oct 2025"
    got = one(spark, md, text.credit_fields)
    assert tuple(got) == (D("1234.56"), D("0.1990"), D("25.00"), "14 Oct 2025")
    assert tuple(one(spark, "", text.credit_fields)) == (None, None, None, None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("sort 12-34-56 end", "sort [SORT_CODE] end"),
        ("GB29NWBK60161331926819", "[IBAN]"),
        ("live at SW1A 1AA now", "live at [POSTCODE] now"),
        ("+44 7700 900 123", "[PHONE]"),
        ("07700900123", "[PHONE]"),
        ("a.b@c.co.uk", "[EMAIL]"),
        ("4111 1111 1111 1111", "[CARD]"),
        ("4111 1111 1111 1112", "4111 1111 1111 1112"),
        ("AB123456C", "[NI_NUMBER]"),
        ("12 High Street.", "[ADDRESS]"),
        ("ref 123456789", "ref [NUM]"),
        ("Jane Doe paid", "[NAME] paid"),
        (None, ""),
        ("£12.50 at Tesco", "£12.50 at Tesco"),
    ],
)
def test_masking(spark, raw, want):
    got = one(spark, raw, lambda c: pii.mask(c, ("jane doe",)))
    assert got == want
    assert one(spark, got, lambda c: pii.mask(c, ("jane doe",))) == got
    assert one(spark, got, pii.residual) is None


def test_guard(spark):
    assert one(spark, "mail a@b.cd", pii.residual) == "EMAIL"
    with pytest.raises(Exception, match="personal data left"):
        spark.createDataFrame([("x 123456789",)], "c string").select(pii.assert_none("c")).collect()


def test_tokens_round_trip(spark):
    rows = [("s1", 1, "mail a@b.cd or 123456789"), ("s1", 2, "account 987654321 and a@b.cd"), ("s2", 1, "other@b.cd"), ("s2", 2, None)]
    got = pii.tokenize(spark.createDataFrame(rows, "session string, seq long, text string")).cache()
    texts = {(r.session, r.seq): r.text for r in got.collect()}
    assert texts["s1", 1] == "mail <<EMAIL_001>> or <<NUM_001>>"
    assert texts["s1", 2] == "account <<ACCT_001>> and <<EMAIL_001>>"
    assert texts["s2", 1] == "<<EMAIL_001>>" and texts["s2", 2] == ""
    back = got.select("session", "seq", pii.detokenize(F.concat("text", F.lit("<<X_009>>")), "tokens").alias("t")).collect()
    assert {(r.session, r.seq): r.t for r in back} == {(s, q): t or "" for s, q, t in rows}


def parse(spark, md, sign="bank"):
    d = spark.createDataFrame([("d", sign, md)], "id string, sign string, md string")
    return [(r.date, r.raw_description, r.amount) for r in statements.parse(d).orderBy("line", "part").collect()]


HEAD = "| Card Ending | Date of transaction | Date entered | Description | Description | Amount £ |\n|---|---|---|---|---|---|\n"


def test_card_split_over_rows(spark):
    md = f"## Your credit card statement 14 April 2026\n\n{HEAD}| 1588 | | | | LEEDS | 10.98 |\n| | 16 MARCH | 17 MARCH | SHOP | | |\n| | NEW BALANCE | | | | 99.00 |"
    assert parse(spark, md, "credit") == [(date(2026, 3, 16), "SHOP LEEDS", D("-10.98"))]


def test_card_merged_row(spark):
    md = f"## Your credit card statement 14 April 2026\n\n{HEAD}| 1 1 | 17 MARCH 18 MARCH | x | ONE | | 141.18 40.00 |\n| 1 1 | 19 MARCH 20 MARCH | x | PAID | | 1,720.30 CR 12.99 |"
    got = parse(spark, md, "credit")
    assert [(d.day, a) for d, _, a in got] == [(17, D("-141.18")), (18, D("-40.00")), (19, D("1720.30")), (20, D("-12.99"))]
    assert got[1][1] == "(missing description)"


def test_too_few_amounts_yield_nothing(spark):
    md = f"## Your credit card statement 14 April 2026\n\n{HEAD}| 1 1 | 17 MARCH 18 MARCH | x | ONE | | 141.18 |"
    assert parse(spark, md, "credit") == []


def test_savings_with_bare_cells(spark):
    md = "| Date | Description | Type | Money In (£) | Money Out (£) | Balance (£) |\n|---|---|---|---|---|---|\n| 01 Apr 25 | SHOP | DEB | Money | 51.90 | 1 |\n| 02 Apr 25 | RENT | DD | Money I bla | Money Out 169.69 | 1 |\n| 03 Apr 25 | PAY | FPI | Money 2,500.00 | | 1 |\n| 99 Apr 25 | BAD | FPI | 1.00 | | 1 |"
    assert [(d.day, a) for d, _, a in parse(spark, md)] == [(1, D("-51.90")), (2, D("-169.69")), (3, D("2500.00"))]


def test_plain_rows(spark):
    assert parse(spark, "2025-04-01  COFFEE SHOP   4.50   100.00\n2025-04-02  PAYMENT THANKS   50.00   50.00", "credit") == [(date(2025, 4, 1), "COFFEE SHOP", D("-4.50")), (date(2025, 4, 2), "PAYMENT THANKS", D("50.00"))]


def test_completeness(spark):
    d = spark.createDataFrame([("d", "bank", "| 2025-04-01 | A | 5.00 | 1,000.25 |\nTotal 7.77")], "id string, sign string, md string")
    row = statements.missing_values(d, statements.parse(d)).first()
    assert row.missing == ["1000.25", "7.77"] and row.warning == "1000.25, 7.77"


def test_file_metadata(spark):
    f = spark.createDataFrame([("file:/x/Credit Main/2025_04.pdf",), ("file:/x/savings/odd.pdf",)], "path string")
    one, two = statements.file_metadata(f).collect()
    assert (one.account_id, one.type, one.period_start, one.period_end, one.statement_id) == ("acct_credit_main", "credit", date(2025, 4, 1), date(2025, 4, 30), "stmt_credit_main_2025_04")
    assert two.period_start is None


def test_edges_and_spaces_are_those_of_the_sql(spark):
    """a letter outside ASCII beside a number or word is an edge for RE2, so it must be one here."""
    import duckdb

    from tallyforge.plans import stored

    said = ["über12345678ä", "12 Große Müller Stäbe", "ä7 Foo Stü", "a 1\x0b High Street", "für07700900123", "ö4111 1111 1111 1111ß", "ßx@y.de", "7 High Street."]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = sorted(tuple(r) for r in rows.select("doc_id", F.sha2(pii.mask("text", ("loser",)), 256), pii.residual("text")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in enumerate(said)])
    assert got == sorted(con.execute(stored.registry.ORACLES["x19_mask_emails_and_numbers"]).fetchall())
    assert one(spark, "ä5.00ü", text.currency_values) == ["5.00"]


def test_documents_are_parsed_without_a_shuffle(spark):
    """Two card tables, the second after a split row; rows before the first card row of a table belong to none; each document for itself."""
    short = "| Date of transaction | Description | Amount £ |\n|---|---|---|\n"
    card = f"## Your credit card statement 14 January 2026\n\n{HEAD}| | | | LOST | | |\n| 1588 | 30 DECEMBER | x | SHOP | LEEDS | 10.98 |\n| | | | ROAD | | |\n\n{short}| | LOST | |\n| 2 JANUARY | CAFE | 1.00 |\n| | BAR | |"
    plain = "| 2025-13-01 | BAD | 1.00 |\n2025-04-01  WIDE   4.50   100.00"
    d = spark.createDataFrame([("c", "credit", card), ("c", "bank", "| 2025-04-02 | SHOP | (5.00) |"), ("p", "bank", plain), ("n", "bank", None)], "id string, sign string, md string")
    rows = statements.parse(d, "sign")
    got = sorted((r.doc, r.sign, r.date, r.raw_description, r.amount) for r in rows.collect())
    assert got == [
        ("c", "bank", date(2025, 4, 2), "SHOP", D("-5.00")),
        ("c", "credit", date(2025, 12, 30), "SHOP LEEDS", D("-10.98")),
        ("c", "credit", date(2026, 1, 2), "CAFE", D("-1.00")),
    ]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
