import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fraudloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are missing")
    return path


CARD = (
    "id long, card_id string, user_id long, card_number string, exp_month string, exp_year string, "
    "customer_id string, email string, address_city string, address_country string, address_state string, "
    "address_zip string, name_on_card string"
)


@pytest.fixture(scope="session")
def cards(spark):
    """Shared cards, missing keys, malformed e-mail and dates."""
    rows = [
        (1, "c1", 1, "4000", "08", "2024", "cus1", "a@x.com", "P", "INDIA", "MH", "111222", "A"),
        (2, "c2", 2, "4000", "8", "2026", "cus1", "b@x.com", "P", "USA", "NY", "511111", "B"),
        (3, "c3", 2, "4000", "xx", None, "cus1", "bad", "P", None, None, "511111", None),
        (4, "c4", 3, None, None, "2027", None, None, "Q", "INDIA", "MH", None, "D"),
        (5, "c5", 3, None, "12", "2028", None, "e@y.com@z", "Q", "INDIA", "KA", "9", "E"),
        (6, "c6", 4, "4001", "1", "2029", "cus2", "f@y.com", "R", "INDIA", "KA", "9", "F"),
    ]
    return spark.createDataFrame(rows, CARD)
