"""CSV reading, detection, validation and canonicalization."""

import pytest
from pyspark.sql import functions as F

from voicegrid.functions.casts import date_formats_of, to_time
from voicegrid.operators import canonical, naming, profiling, validation
from voicegrid.schema import (
    ColumnMapping, CsvLoadError, CsvParseError, DatasetInvalidError, EmptyCsvError, FeedbackError, IngestConfig,
    RowLimitError, UnsupportedFileError,
)
from voicegrid.sources.csv import load_csv, load_labelled


def put(folder, name, payload):
    path = folder / name
    path.write_bytes(payload)
    return str(path)


def test_csv_encodings(spark, tmp_path):
    marked = load_csv(spark, put(tmp_path, "a.csv", 'Feedback,Stars\n"said ""hi"", ok",5\nshort\nNA,4\n'.encode("utf-8-sig")))
    assert marked.encoding == "utf-8-sig" and marked.dataframe.columns == ["Feedback", "Stars"]
    assert [tuple(r) for r in marked.dataframe.collect()] == [('said "hi", ok', "5"), ("short", None), (None, "4")]
    western = load_csv(spark, put(tmp_path, "b.csv", "message\nCaf\xe9 \x80\n".encode("latin-1")))
    assert (western.encoding, western.dataframe.first()[0]) == ("cp1252", "Café €")
    latin = load_csv(spark, put(tmp_path, "c.csv", "message\nCaf\xe9 \x81\n".encode("latin-1")))
    assert latin.encoding == "latin-1"
    multi = load_csv(spark, put(tmp_path, "d.CSV", b'message,x\n"two\nlines",3\n'))
    assert multi.dataframe.first()[0] == "two\nlines"


@pytest.mark.parametrize(
    ("name", "payload", "error"),
    [
        ("e.csv", b"", EmptyCsvError), ("f.csv", b"message,x\n", EmptyCsvError), ("g.csv", b"a,b\n1,2,3\n", CsvParseError),
        ("h.txt", b"a,b\n", UnsupportedFileError),
    ],
)
def test_csv_failures(spark, tmp_path, name, payload, error):
    with pytest.raises(error):
        load_csv(spark, put(tmp_path, name, payload))


def test_csv_limits(spark, tmp_path):
    path = put(tmp_path, "i.csv", b"message\none\ntwo\nthree\n")
    with pytest.raises(RowLimitError):
        load_csv(spark, path, IngestConfig(max_rows=2))
    assert load_csv(spark, path, IngestConfig(max_rows=3)).dataframe.count() == 3
    assert load_labelled(spark, path).count() == 3
    with pytest.raises(CsvLoadError):
        load_csv(spark, str(tmp_path / "absent.csv"))


def test_files_with_other_headers(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    put(folder, "1.csv", b"message,stars\none,5\n\"two, too\",4\n")
    put(folder, "2.csv", "\ufeffstars,message\r\n3,three\r\n".encode())
    put(folder, "3.csv", b"message,stars\nfour,NA\n")
    put(folder, "4.csv", b"product,message\nphone,five\n")
    put(folder, "5.csv", b"")
    found = load_csv(spark, str(folder)).dataframe
    assert found.columns == ["message", "stars", "product"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("one", "5", None), ("two, too", "4", None), ("three", "3", None), ("four", None, None), ("five", None, "phone")], key=str
    )
    put(folder, "6.csv", b"stars,message\n1,2,3\n")
    with pytest.raises(CsvParseError):
        load_csv(spark, str(folder))


def test_header_names(spark):
    assert naming.normalize_name("  Café Réview! ") == "cafe_review"
    assert naming.normalize_name("***") == "column"
    frame = spark.createDataFrame([(1, 2, 3)], "`Review Text` int, `Review-Text` int, `Star Rating` int")
    renamed, audit = naming.normalize_names(frame)
    assert renamed.columns == ["review_text", "review_text_2", "star_rating"]
    assert audit["Review-Text"] == "review_text_2"
    clash = spark.createDataFrame([(1, 2, 3)], "a int, `a 2` int, `A!` int")
    assert len(set(naming.normalize_names(clash)[0].columns)) == 3


def test_name_scores():
    assert [profiling.keyword_score(n) for n in ("review", "customer_review", "reviewer", "stars")] == [1.0, 0.9, 0.7, 0.0]
    assert [profiling.alias_score(n, ("date", "app")) for n in ("date", "order_date", "updated", "happy")] == [3, 2, 1, 0]


def test_detection(spark):
    rows = [("Battery lasts all day and charges fast", "2026-01-05", "5", "Phone", "1.2"), ("Too slow", "2026-01-06", "2", "Phone", "1.3")]
    frame = spark.createDataFrame(rows, "review_text string, review_date string, stars string, app string, release string")
    assert profiling.detect_text_column(frame) == "review_text"
    assert profiling.detect_metadata_columns(frame, "review_text") == {
        "date": "review_date", "rating": "stars", "product": "app", "version": "release",
    }
    assert profiling.detect_text_column(frame.select("stars", "release")) is None
    unreadable = spark.createDataFrame([("soon", "many")], "date string, rating string")
    assert profiling.detect_metadata_columns(unreadable) == {}


def test_text_score_formula(spark):
    frame = spark.createDataFrame([("good",), ("good",), (" ",), ("12",)], "review string")
    row = profiling.score_text_columns(frame).first()
    length, filled, letters, distinct = 10 / 3, 3 / 4, 2 / 3, 2 / 3
    assert row["score"] == round(0.4 + 0.25 * length / 80 + 0.15 * filled + 0.1 * letters + 0.1 * distinct, 6)


@pytest.fixture
def raw(spark):
    rows = [
        ("A", "  Great   app  ", "2026-01-05", " Phone ", "5"), ("B", None, "2026-01-06", "Phone", "4"),
        ("C", "great APP", "2026-01-07", "Phone", "3"), ("D", "Slow", "not a date", "", "n.a."),
    ]
    return spark.createDataFrame(rows, "review_id string, review string, created_at string, product_name string, stars string")


MAPPING = ColumnMapping("review", date="created_at", rating="stars", product="product_name")


@pytest.mark.parametrize("order_by", [None, "review_id"])
def test_canonical_table(raw, order_by):
    result = canonical.prepare_dataset(raw, MAPPING, order_by=order_by)
    rows = result.dataframe.orderBy("review_id").collect()
    assert result.dataframe.columns == ["review_id", "review_text", "clean_text", "date", "rating", "product"]
    assert [(r.review_id, r.review_text, r.clean_text, r.rating, r["product"]) for r in rows] == [
        ("A", "  Great   app  ", "Great app", 5.0, "Phone"), ("D", "Slow", "Slow", None, None),
    ]
    assert rows[1]["date"] is None
    assert tuple(result.statistics.first()) == (4, 2, 1, 1)
    assert {w["code"] for w in result.warnings().rows} == {"invalid_dates_coerced", "invalid_ratings_coerced"}


@pytest.mark.parametrize("order_by", [None, "created_at"])
def test_generated_ids(raw, order_by):
    rows = canonical.canonicalize(raw.drop("review_id"), MAPPING, order_by=order_by).dataframe.collect()
    assert {r.review_id: r.clean_text for r in rows} == {"review_000001": "Great app", "review_000002": "Slow"}


def test_repeated_source_ids_are_not_used(spark):
    frame = spark.createDataFrame([("x", "one", 1), ("x", "two", 2), ("x", "ONE", 3)], "id string, review string, n int")
    rows = canonical.canonicalize(frame, ColumnMapping("review"), order_by="n").dataframe.collect()
    assert {r.review_id: r.review_text for r in rows} == {"review_000001": "one", "review_000002": "two"}


def test_hot_duplicate_group(spark):
    """A third of the rows are one text; ids stay gapless and in order."""
    rows = spark.range(3000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "Same text").otherwise(F.concat(F.lit("text "), "id")).alias("review")
    )
    result = canonical.canonicalize(rows.repartition(7), ColumnMapping("review"), order_by="n")
    found = result.dataframe.orderBy("review_id").collect()
    expected = ["Same text", *(f"text {n}" for n in range(3000) if n % 3)]
    assert [r.review_text for r in found] == expected
    assert [r.review_id for r in found] == [f"review_{i:06d}" for i in range(1, len(expected) + 1)]


def codes(report):
    return [row["code"] for row in report.rows]


def test_validation_rules(spark, raw):
    report = validation.validate_dataset(raw, MAPPING)
    assert report.is_valid and codes(report) == ["empty_reviews_removed", "duplicate_reviews_removed"]
    assert report.to_df(spark).count() == 2
    assert codes(validation.validate_dataset(raw.limit(0), MAPPING)) == ["empty_dataset"]
    assert codes(validation.validate_text_column(raw, "nothing")) == ["text_column_missing"]
    assert codes(validation.validate_text_column(raw.withColumn("review", F.lit(" ")), "review")) == ["text_column_empty"]
    assert codes(validation.validate_text_column(raw, "stars")) == ["text_column_not_text_like"]
    assert codes(validation.validate_mapping(raw, ColumnMapping("review", date="when", rating="review"))) == [
        "mapped_column_missing", "duplicate_column_mapping",
    ]
    empty_column = raw.withColumn("notes", F.lit(None).cast("string"))
    assert codes(validation.validate_table(empty_column)) == ["empty_columns"]
    assert codes(validation.validate_table(raw, IngestConfig(max_rows=3))) == ["row_limit_exceeded"]
    sparse = spark.range(100).select(F.when(F.col("id") == 0, "A fine review text").alias("review"))
    assert codes(validation.validate_text_column(sparse, "review"))[-1] == "low_text_coverage"


def test_invalid_dataset_is_refused(raw):
    with pytest.raises(DatasetInvalidError, match="does not exist"):
        canonical.prepare_dataset(raw, ColumnMapping("nothing"))
    with pytest.raises(FeedbackError):
        canonical.canonicalize(raw, ColumnMapping("nothing"))


@pytest.mark.parametrize(
    ("cells", "format"),
    [
        (["2024-01-15", "2024-02-03 10:00:00", "soon"], ()),
        (["01/15/2024", "2/3/2024", None, "bad"], ("M/d/yyyy[ H:mm[:ss]]",)),
        (["15/01/2024", "03/02/2024 09:30"], ("d/M/yyyy[ H:mm[:ss]]",)),
        (["15.01.2024", "3.2.2024"], ("d.M.yyyy[ H:mm[:ss]]",)),
        (["15 Jan 2024", "3 Feb 2024", ""], ("d MMM yyyy[ H:mm[:ss]]",)),
        (["January 15, 2024", "February 3, 2024"], ("MMMM d, yyyy[ H:mm[:ss]]",)),
    ],
)
def test_dates_in_common_formats(spark, cells, format):
    df = spark.createDataFrame([(f"review number {k} is long enough", c) for k, c in enumerate(cells)], "message string, created_at string")
    assert date_formats_of(df, "created_at") == format
    read = df.select(to_time(df, "created_at", format).cast("date").alias("day")).collect()
    assert [str(r["day"]) for r in read[:2]] == ["2024-01-15", "2024-02-03"] and all(r["day"] is None for r in read[2:])
    assert profiling.detect_metadata_columns(df, "message")["date"] == "created_at"
