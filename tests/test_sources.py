import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ebbtide.runtime import materialized, one_row, resolved_row
from ebbtide.sources import ingest, sinks
from ebbtide.sources import transactions as src


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [("1", "A", "pen", 2, "2020-01-01 10:00:00", 3.5, 7.0, "X"), ("2", "A", "pen", 1, "bad", 3.5, 8.0, "X"),
         ("3", "A", "pen", 1, "2020-01-02 10:00:00", 3.5, None, "X")],
        "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, Price double, "
        "`Customer ID` double, Country string")


def test_typed_layout(raw):
    tx = src.typed_transactions(raw)
    assert dict(tx.dtypes)["invoice_date"] == "timestamp_ntz"
    rows = tx.orderBy("invoice_no").collect()
    assert rows[0]["customer_id"] == "7.0" and rows[0]["line_amount"] == 7.0
    assert rows[1]["invoice_date"] is None


def test_missing_input_raises(spark):
    with pytest.raises(AnalysisException):
        src.read_transactions(spark, "/nowhere/at/all")


def test_clean_table_or_raw(spark, raw, tmp_path):
    raw_path, clean_path = str(tmp_path / "raw"), str(tmp_path / "clean")
    raw.withColumnsRenamed({"Customer ID": "CustomerID"}).write.parquet(raw_path)
    fallback = src.read_clean_or_raw(spark, clean_path, raw_path)
    assert [(r["invoice_no"], r["customer_id"], r["unit_price"]) for r in fallback.collect()] == [("1", "7", 3.5)]
    src.typed_transactions(raw).drop("line_amount").withColumnRenamed("price", "unit_price").write.parquet(clean_path)
    assert src.read_clean_or_raw(spark, clean_path, raw_path).count() == 3


def test_csv_round_trip(spark, raw, tmp_path):
    tx = src.typed_transactions(raw).select(*[f.name for f in src.TRANSACTION_SCHEMA])
    path = str(tmp_path / "csv")
    sinks.write_table(tx, path)
    again = src.read_csv(spark, path, src.TRANSACTION_SCHEMA)
    key = lambda f: sorted(map(str, f.collect()))
    assert key(again) == key(tx)
    assert src.read_transactions(spark, path, "csv").count() == 3


def test_metrics(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 0.7)], "precision double, recall double")
    path = str(tmp_path / "metrics")
    sinks.write_metrics(metrics, path)
    assert src.read_metrics(spark, path).first().asDict() == {"precision": 0.5, "recall": 0.7}
    assert [tuple(r) for r in sinks.metrics_long(metrics).collect()] == [("precision", 0.5), ("recall", 0.7)]


def test_dictionary(spark):
    frame = spark.createDataFrame([("a", 1, None, None), ("b", None, None, None)], "customer_id string, n int, x double, at timestamp_ntz")
    described = sinks.with_comments(frame, {"n": "How many"})
    rows = [tuple(r) for r in sinks.data_dictionary(described, {"x": "How much"}).collect()]
    assert rows == [
        (1, "customer_id", "string", "", 2), (2, "n", "int", "How many", 1),
        (3, "x", "float", "How much", 0), (4, "at", "datetime", "", 0)]


def test_predictions(spark):
    scored = spark.createDataFrame([(1, 0.123456)], "y_true int, y_prob double")
    assert tuple(sinks.export_predictions(scored).first()) == (1, 0.1235)


def test_rows_as_parameters(spark):
    frame = spark.createDataFrame([(3, "2020-01-01 00:00:00.123456")], "n int, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = resolved_row(frame)
    row = spark.range(1).select(got["n"].alias("n"), got["at"].alias("at"), one_row(frame)["at"].alias("b")).first()
    assert row["n"] == 3 and row["at"] == row["b"] and row["at"].microsecond == 123456


def test_materialized_reads_what_was_written(spark):
    stored = materialized(spark.range(10).withColumn("x", F.col("id") * 2))
    assert stored.agg(F.sum("x")).first()[0] == 90
    assert spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]


def delivery(spark, tmp_path, *lines, header="Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country", **options):
    folder = tmp_path / "delivery"
    folder.mkdir()
    (folder / "part.csv").write_text("\n".join([header, *lines]) + "\n")
    return ingest.ingest(spark, str(folder), **options)


def test_bad_rows_are_set_apart_with_all_their_reasons(spark, tmp_path):
    found = delivery(
        spark, tmp_path, "1,A,pen,2,2020-01-01 10:00:00,3.5,7.0,X", "2,A,,,,,,", "3,A,pen,two,soon,3.5,8,X", "4,A,pen,1,2020-01-01 10:00:00,3.5,n/a,X",
        ",A,pen,1,2020-01-01 10:00:00,free,9,X", "6,A,pen,1,2020-01-01 10:00:00,3.5,9,X,more", "7,A", '8,A,"a, b",1,2020-01-01 10:00:00,3.5,9,X')
    good = {r["invoice_no"]: r for r in found.good.collect()}
    assert set(good) == {"1", "2", "8"} and good["1"]["line_amount"] == 7.0 and good["8"]["description"] == "a, b"
    assert good["2"]["quantity"] is None and dict(found.good.dtypes)["invoice_date"] == "timestamp_ntz"
    bad = {r["invoice_no"]: (r["reasons"], r["delivered_line"]) for r in found.rejected.collect()}
    assert bad["3"] == (["bad quantity", "bad date"], None) and bad["4"] == (["bad customer id"], None)
    assert bad[None] == (["bad price", "no invoice"], None)
    assert bad["6"][0] == ["malformed line"] and bad["6"][1].endswith(",more") and bad["7"][0] == ["malformed line"]
    assert {r["outcome"]: r["rows"] for r in found.counts().collect()} == {
        "accepted": 3, "rejected": 5, "malformed line": 2, "bad quantity": 1, "bad date": 1, "bad price": 1, "bad customer id": 1, "no invoice": 1}


def test_headers_in_another_order_and_other_names(spark, tmp_path):
    found = delivery(spark, tmp_path, "X,7,3.5,2020-01-01 10:00:00,2,pen,A,1", header="country,customer_id,price,invoice_date,quantity,description,stock_code,invoice_no")
    assert found.good.first()["quantity"] == 2 and found.good.first()["invoice_no"] == "1" and found.rejected.count() == 0


def test_a_header_without_a_field_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="price, customer_id"):
        delivery(spark, tmp_path, "1,A,pen,2,2020-01-01 10:00:00,X", header="Invoice,StockCode,Description,Quantity,InvoiceDate,Country")


def test_a_delivery_without_rows(spark, tmp_path):
    found = delivery(spark, tmp_path)
    assert found.good.count() == 0 and {r["rows"] for r in found.counts().collect()} == {0}


def test_own_rules(spark, tmp_path):
    found = delivery(spark, tmp_path, "1,A,pen,2,2020-01-01 10:00:00,3.5,K7,X", checks=ingest.rules(r"^K[0-9]+$") | {"too few": F.col("quantity").cast("int") < 3})
    assert found.good.count() == 0 and found.rejected.first()["reasons"] == ["too few"]


def test_folders_of_a_table_are_read_alone(spark):
    table = materialized(spark.range(60).selectExpr("id % 3 AS kind", "id"), ["kind"])
    assert table.columns == ["kind", "id"] and table.filter("kind = 1").count() == 20
    assert all("kind=1" in path for path in table.filter("kind = 1").select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
