import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from assayer.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, "4g")


@pytest.fixture(scope="session")
def messy(spark):
    """Twelve dirty rows: a repeated record, bad numbers and dates, mixed spellings, gaps."""
    rows = [
        (1, "M-01", 25.0, "delhi", "2024-01-05", "yes", "Good value overall"),
        (2, "M-02", 31.0, "Delhi", "2024-02-06", "no", "  late "),
        (3, "M-03", None, "Delhi", "2024-03-07", "yes", "n/a"),
        (4, "M-04", -4.0, "Pune", "2024-04-08", "no", "fine"),
        (5, "M-05", 28.0, None, "2024-05-09", "yes", "ok"),
        (6, "M-06", 33.0, "Delhi", "2024-06-10", "no", "ok"),
        (7, "M-07", 30.0, "Pune", "2024-07-11", "yes", "slow"),
        (8, "M-08", 150.0, "Delhi", "oops", "no", "bad"),
        (9, "M-09", 29.0, "Pune", None, "yes", "good"),
        (10, "M-10", 27.0, "Delhi", "2024-10-14", "no", "fine"),
        (11, "M-11", 26.0, "Delhi", "2024-11-15", "yes", "fine"),
        (12, "M-11", 26.0, "Delhi", "2024-11-15", "yes", "fine"),
    ]
    fields = ("row_id long, member_id string, age double, city string, joined_date string, "
              "is_active string, review string")
    return spark.createDataFrame(rows, fields)
