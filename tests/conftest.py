"""Shared session and literal review tables."""

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


ASPECT_TEXTS = [
    ("r1", "The battery life is great but charging the battery is slow to start", "Positive", 0.9, 5),
    ("r2", "Shipping was late and the packaging was torn", "Negative", 0.8, 2),
    ("r3", "Customer support explained the interface; it is easy to use", "Positive", 0.7, 4),
    ("r4", "Too expensive for the price, build quality is poor quality", "Negative", 0.95, 1),
    ("r5", "I like the colour", "Neutral", 0.6, 3),
]


@pytest.fixture(scope="session")
def aspect_reviews(spark):
    rows = [(i, t, t, s, p, 0, "Topic", r) for i, t, s, p, r in ASPECT_TEXTS]
    return spark.createDataFrame(
        rows,
        "review_id string, review_text string, clean_text string, sentiment_label string, sentiment_score double, "
        "topic_id int, topic_label string, rating int",
    )


EARLY, LATE = datetime(2026, 1, 5), datetime(2026, 2, 5)
# id, date, topic, label, rating, text
INSIGHT_ROWS = [
    ("i01", EARLY, "Battery", "Positive", 5, "battery good"),
    ("i02", EARLY, "Battery", "Positive", 4, "battery fine"),
    ("i03", EARLY, "Battery", "Neutral", 3, "battery okay"),
    ("i04", EARLY, "Support", "Positive", 5, "support helped"),
    ("i05", EARLY, "Support", "Positive", 4, "support friendly"),
    ("i06", EARLY, "Billing / Payment", "Neutral", 3, "invoice arrived"),
    ("i07", LATE, "Billing / Payment", "Negative", 1, "invoice wrong"),
    ("i08", LATE, "Billing / Payment", "Negative", 1, "refund missing"),
    ("i09", LATE, "Billing / Payment", "Negative", 2, "charged twice"),
    ("i10", LATE, "Billing / Payment", "Negative", 1, "payment failed"),
    ("i11", LATE, "Battery", "Positive", 5, "battery lasts"),
    ("i12", LATE, "Support", "Positive", 4, "support quick"),
]


@pytest.fixture(scope="session")
def insight_reviews(spark):
    rows = [(i, d, n, t, l, 0.9, r, text, text, "App") for n, (i, d, t, l, r, text) in enumerate(INSIGHT_ROWS)]
    return spark.createDataFrame(
        rows,
        "review_id string, date timestamp, topic_id int, topic_label string, sentiment_label string, "
        "sentiment_score double, rating int, review_text string, clean_text string, product string",
    )


THEMES = {
    "Battery": "battery charging power lasts hours charger drain cable overnight percent",
    "Delivery": "delivery courier parcel shipping package late arrived doorstep driver tracking",
    "Support": "support agent helpful answered phone call ticket resolved staff polite",
}


@pytest.fixture(scope="session")
def themed_reviews(spark):
    rows = []
    for label, (theme, text) in zip(("Positive", "Negative", "Neutral"), THEMES.items()):
        words = text.split()
        for n in range(10):
            mixed = " ".join(words[(n * 3 + k) % 10] for k in range(6)) + f" item{n}{theme.lower()}"
            rows.append((f"{theme}-{n}", mixed, mixed, label, 0.9, theme))
    return spark.createDataFrame(
        rows,
        "review_id string, review_text string, clean_text string, sentiment_label string, sentiment_score double, product string",
    )
