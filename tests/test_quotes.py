"""Scalars, lookups, numbering, patches and folds on small tables; every registered query against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import js, text
from quillspark.operators import acquisition, quotes
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string", list: "array<double>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("r")).head()["r"]


@pytest.mark.parametrize(("name", "want"), [(None, "XX"), ("", "XX"), ("  ", "XX"), ("Ana", "A"), ("ana maria lopez", "AL")])
def test_initials(spark, name, want):
    assert one(spark, text.initials(F.col("a")), a=name) == want


@pytest.mark.parametrize(("name", "want"), [(None, "CUS"), ("A", "ACU"), ("AB", "ABC"), ("3M Co.", "3MC"), ("--", "CUS")])
def test_customer_key(spark, name, want):
    assert one(spark, text.customer_key(F.col("a")), a=name) == want


@pytest.mark.parametrize(("x", "want"), [(0.125, "0.13"), (1.005, "1.00"), (2.345, "2.35"), (-0.125, "-0.13"), (1234.5, "1234.50")])
def test_fixed2(spark, x, want):
    assert one(spark, js.fixed2(F.col("a")), a=x) == want


@pytest.mark.parametrize(("x", "want"), [(12.0, "12"), (0.0005, "0.0005"), (float("inf"), "Infinity"), (float("nan"), "NaN"), (0.0, "0"), (1.5, "1.5"), (100.0, "100")])
def test_number_text(spark, x, want):
    assert one(spark, js.number_text(F.col("a")), a=x) == want


@pytest.mark.parametrize(("x", "want"), [("12abc", 12.0), (" .5", 0.5), ("", 0.0), (None, 0.0), ("x", 0.0), ("-3e2z", -300.0)])
def test_leading_number(spark, x, want):
    assert one(spark, js.leading_number(F.col("a")), a=x) == want


@pytest.mark.parametrize(("product", "value", "want"), [("P", 0.0, "Product: P\nValue: $0.00"), ("", 0.0, ""), ("", 2.5, "Value: $2.50"), ("P", None, "Product: P")])
def test_deal_note(spark, product, value, want):
    assert one(spark, text.deal_note(F.lit(None).cast("string"), F.col("p"), F.col("v").cast("double")), p=product, v=value) == want


RETURNS = [("/a?app_id=1&x=2", "/a?x=2"), ("//evil.com", "/"), ("https://evil.com/a", "/"), ("https://me.org/b#c", "/b"), ("/.//evil.com", "/"), ("/\\evil.com", "/"), (None, "/"), ("https://me.org.evil.com/", "/"),
    ("/\t/evil.com", "/"), ("/?%61pp_id=9&x=1", "/?x=1"), ("/a?x=1&app%5Fid=2", "/a?x=1"), ("/a/../b", "/b"), ("/%2e//evil.com", "/"), ("a/b", "/a/b"), (" /a", "/a"), ("HTTPS://ME.org/b", "/b"),
    ("/a/%2E%2e/./b/..", "/"), ("/a/b/.", "/a/b/"), ("/../../a", "/a"), ("https:\\\\me.org\\b", "/b"), ("https:b", "/b"), ("http:b", "/"), ("https:/me.org/x", "/me.org/x"), ("https:///me.org/x", "/x"), ("///me.org/x", "/x"), ("\\\\evil.com", "/"), ("https://me.org:443/p", "/p"),
    ("https://me.org:0443/p", "/p"), ("https://me.org:8443/p", "/"), ("https://me.org:99999/p", "/"), ("https://user:pw@me.org/p", "/p"), ("https://me.org@evil.com/p", "/"), ("https://m%65.org/p", "/p"), ("javascript:alert(1)", "/"), ("data:text/html,x", "/"), ("http://me.org/p", "/"),
    ("https://", "/"), ("https://me org/", "/"), ("?q=1&&from_url=z", "/?q=1"), ("#x", "/"), ("/a b\"<é{}^`c", "/a%20b%22%3C%C3%A9%7B%7D%5E%60c"), ("/100%/%zz%41", "/100%/%zz%41"), ("/?a=b c&d=%20e+f&g", "/?a=b+c&d=+e+f&g="), ("/?x=%&y=\\", "/?x=%25&y=%5C"), ("/a\n/..\t/b", "/b"), ("", "/"), ("/;a=1,b:(c)!$&'*+~[|]@", "/;a=1,b:(c)!$&'*+~[|]@"),
]


def test_return_path(spark):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(RETURNS)], "k int, a string")
    got = {r["k"]: r["path"] for r in rows.select("k", text.return_path(F.col("a"), "https://me.org").alias("path")).collect()}
    assert [(raw, got[k]) for k, (raw, _) in enumerate(RETURNS)] == RETURNS


@pytest.mark.parametrize(("points", "want"), [([1.0, 2.0, 5.0, 2.0, 5.0, 9.0, 1.0, 9.0], (1.0, 2.0, 4.0, 7.0)), ([], (0.0, 0.0, 0.0, 0.0))])
def test_polygon_box(spark, points, want):
    assert tuple(one(spark, acquisition.polygon_box(F.col("a")), a=points)) == want


def test_misc(spark):
    assert one(spark, text.page_url(F.lit("My Page"))) == "/My-Page"
    assert one(spark, text.status_label(F.lit("zzz"))) == "New"
    assert one(spark, js.rounded2(F.lit(-2.505))) == -2.5
    assert one(spark, text.percent(F.lit(None).cast("double"))) == "n/a"
    assert one(spark, text.date_code(F.lit("2026-01-05").cast("timestamp"))) == "01052026"


def test_numbering(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 1)], "prefix string, at int")
    old = spark.createDataFrame([("A", "A-007"), ("A", "A-001"), ("B", "B-999"), ("C", "C-1000")], "prefix string, quote_number string")
    got = [r["quote_number"] for r in quotes.numbered(df, "prefix", ("at",), old).orderBy("prefix", "at").collect()]
    assert got == ["A-008", "A-009", "B-1000", "C-001"]


def test_deals(spark):
    deal = "id string, title string, name string, value double, amount double, account_id string, account_name string, contact_id string, contact_name string, contact_email string, product string, product_name string"
    rows = [("1", None, "n", None, 7.0, "a", None, "c", "own", "own@x", None, "pn"), ("2", "t", None, 0.0, 7.0, "a", "set", "zz", "own", "own@x", "p", None), ("3", None, None, None, None, None, None, None, None, None, None, None)]
    got = {r["id"]: r for r in quotes.resolve_deals(spark.createDataFrame(rows, deal), spark.createDataFrame([("a", "Acme")], "id string, name string"), spark.createDataFrame([("c", "Ann", "", None)], "id string, first_name string, last_name string, email string")).collect()}
    assert got["1"][1:] == ("n", 7.0, "a", "Acme", "c", "Ann", "", "pn")
    assert got["2"][1:] == ("t", 0.0, "a", "set", "zz", "own", "own@x", "p")
    assert got["3"][1:] == ("", None, "", "", "", "", "", "")


def test_patches_keep_nulls(spark):
    rows = [(1, 1, "new", 5.0, ["status", "total"]), (1, 2, None, None, ["status"]), (1, 3, "x", 9.0, [])]
    got = quotes.latest_state(spark.createDataFrame(rows, "k int, at int, status string, total double, patched array<string>"), "k", ("at",), ("status", "total")).head()
    assert (got["status"], got["total"], got["patches"]) == (None, 5.0, 3)


def test_totals_and_breaks(spark):
    items = "array<struct<quantity:double,price:double>>"
    df = spark.createDataFrame([([(2.0, 3.0), (None, 5.0)],), ([],), (None,)], f"i {items}")
    assert [r[0] for r in df.select(quotes.lines_total(F.col("i"))).collect()] == [6.0, 0.0, 0.0]
    got = one(spark, quotes.page_breaks(F.col("a"), 10.0, 50.0), a=[24.0, 20.0, 10.0])
    assert [(r["page"], r["y"]) for r in got] == [(1, 10.0), (2, 10.0), (2, 30.0)]


def test_email_is_escaped(spark):
    schema = "number string, project_type string, project_name string, customer string, items array<struct<description:string,quantity:double,price:double>>, hours double, rate double, total double, lead_days int, notes string"
    df = spark.createDataFrame([("Q", "sheet_metal", "P&Q", "<A&B>", [("p<", 2.0, 1.5)], 1.5, 9.0, 3.0, 4, 'say "x"\ny'), (None, None, None, None, None, 0.0, 9.0, None, 0, None)], schema)
    full, bare = (r[0] for r in df.select(quotes.email_html({c: F.col(c) for c in df.columns})).collect())
    for part in ("&lt;A&amp;B&gt;", "p&lt;", "$3.00", "sheet metal", "Labor (1.5 hrs @ $9/hr)</td><td>1</td><td>$13.50", "P&amp;Q", "4 days", "say &quot;x&quot;\ny", "Best regards"):
        assert part in full
    assert "Labor" not in bare and "Notes" not in bare and "TBD " in bare and "Total: $0.00" in bare


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(repr(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if sql := catalog.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(found.fetchall(), columns)


def test_append_and_created(spark, tmp_path):
    old = spark.createDataFrame([(1, "sent", 2.0)], "id int, status string, total double")
    new = spark.createDataFrame([(2, None), (3, "quoted")], "id int, status string")
    rows = quotes.created(old, new, {"status": F.lit("new"), "total": F.lit(0.0)})
    assert sorted(map(tuple, rows.collect())) == [(1, "sent", 2.0), (2, "new", 0.0), (3, "quoted", 0.0)]
    for part in (old, rows.filter("id > 1")):
        quotes.append(part, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert quotes.by_optional_key(rows, "id", None).count() == 3 and quotes.by_optional_key(rows, "id", 2).count() == 1


def test_picks(spark):
    df = spark.sql("select array(named_struct('url', 'a'), named_struct('url', 'b')) as d, cast(array() as array<struct<url:string>>) as none, named_struct('url', 'b') as b, named_struct('url', 'z') as z, cast(null as struct<url:string>) as n")
    pick = lambda d, s: df.select(quotes.repicked(F.col(d), F.col(s), "url").alias("r")).head()["r"]
    assert [pick("d", "b")["url"], pick("d", "z")["url"], pick("none", "b"), pick("d", "n")] == ["b", "a", None, None]
    assert df.select(quotes.picked(F.col("none")).alias("r")).head()["r"] is None


MEDIA = [("https://h.org/m/a.png", "https://h.org/m/a.png"), ("https://h.org:443/m/a.png/v1/fill/w_1/b.webp?x", "https://h.org/m/a.png"), ("https://h.org/m/a.svg", None), ("https://u@h.org/m/a.png", None), ("https://h.org:80/m/a.png", None), ("http://h.org/m/a.png", None), ("https://h.org/m/../a.png", None), ("https://h.org/m/x/%2e%2E/a.png", "https://h.org/m/a.png"), ("https:\\\\h.org\\m\\a.png", "https://h.org/m/a.png"), (" https:h.org/m/a b.png", "https://h.org/m/a%20b.png"), ("https://@h.org/m/a.png", "https://h.org/m/a.png"), ("https://h.org/m/a.png/v1/fit/w_1/../b.webp", "https://h.org/m/a.png/v1/fit/b.webp"), ("https://x.org/m/a.png", None), ("/m/a.png", None), (None, None)]


def test_media_source(spark):
    rows = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(MEDIA)], "k int, a string")
    got = {r["k"]: r["s"] and r["s"]["base"] for r in rows.select("k", text.media_source(F.col("a"), {"h.org": "/m/"}).alias("s")).collect()}
    assert [(url, got[k]) for k, (url, _) in enumerate(MEDIA)] == MEDIA


@pytest.mark.parametrize(("crop", "fx", "want"), [(False, None, "/v1/fit/w_6000,h_2,q_80"), (True, None, "/v1/fill/w_6000,h_2,al_c,q_80"), (True, -3.0, "/v1/fill/w_6000,h_2,fp_0.00_0.50,q_80")])
def test_transform_url(spark, crop, fx, want):
    source, focus = F.struct(F.lit("b/a.PNG").alias("base"), F.lit("a.PNG").alias("name")), F.when(F.lit(fx is not None), F.struct(F.lit(fx or 0.0).alias("x"), F.lit(0.5).alias("y")))
    assert one(spark, text.transform_url(source, F.lit(9000.4), F.lit(1.5), F.lit(crop), focus, F.lit(80))) == f"b/a.PNG{want},usm_0.66_1.00_0.01,enc_webp,quality_auto/a.webp"


def test_unknown_files_are_errors(spark):
    from quillspark.sources.tables import checked_extension

    df = spark.createDataFrame([("a.STP",)], "p string")
    assert df.select(checked_extension(F.col("p")).alias("k")).head()["k"] == "step"
    with pytest.raises(Exception, match="no CAD file: a.STP.pdf"):
        df.select(checked_extension(F.concat("p", F.lit(".pdf"))).alias("k")).collect()


def test_priced_line(spark):
    got = [one(spark, quotes.priced_line(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("2", "1.5"), ("x", "3"), ("1.5", None), (None, None))]
    assert [tuple(r) for r in got] == [("2", "$1.50", "$3.00"), ("", "$3.00", ""), ("1.5", "", ""), ("", "", "")]
