import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ripplegraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one_cascade(spark):
    """Five tweets of one cascade, with unknown values, a zero follower count and marks in the texts."""
    rows = [
        ("c1_t0", "u1", "BREAKING!!! See http://x.co #wow", "2024-01-01 00:00:00", 10, 4, True, 0.0, True, 0.9, None),
        ("c1_t1", "u2", "is it true? ...", "2024-01-01 01:00:00", None, 2, False, 50.0, False, 0.0, 0.8),
        ("c1_t2", "u1", "RT @u2: OK", "2024-01-01 03:00:00", 3, 0, False, 0.0, True, 0.9, 0.0),
        ("c1_t3", "u3", "calm words calm", "2024-01-01 06:00:00", 5, 9, False, 200.0, False, 0.4, 0.2),
        ("c1_t4", "u4", "NO WAY!!", "2024-01-02 00:00:00", 1, 1, False, 7.0, False, 0.3, 0.1),
    ]
    schema = (
        "tweet_id string, user_id string, text string, timestamp string, likes bigint, retweets bigint, is_root boolean, "
        "user_followers double, user_verified boolean, user_credibility double, user_bot_score double"
    )
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "'c1' as news_id", "1 as label", "cast(timestamp as timestamp) as ts"
    ).drop("timestamp").withColumnRenamed("ts", "timestamp")


@pytest.fixture
def predictions(spark):
    rows = [(f"g{i}", "m", y, 1 - p, p, int(p > 0.5)) for i, (y, p) in enumerate(zip([0, 0, 1, 1, 1], [0.1, 0.6, 0.6, 0.8, 0.95]))]
    return spark.createDataFrame(rows, "news_id string, model string, label int, p_real double, p_fake double, pred int")
