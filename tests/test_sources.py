import pytest
"""Reading and writing."""

import json

from pyspark.sql import functions as F

from ripplegraph.session import materialise, scratch_path
from ripplegraph.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tweets_csv(spark, tmp_path):
    path = write(
        tmp_path / "tweets.csv",
        "tweet_id,news_id,user_id,text,timestamp,likes,retweets,is_root,label,extra\n"
        '7,1,3,"a, b",2025-05-26 21:20:15.619675,,2,true,1,z\n'
        "8,,3,,2025-05-26 21:20:16,1,2,false,0,z\n",
    )
    rows = readers.read_tweets(spark, path).collect()
    assert len(rows) == 1  # the row without a news id is gone
    row = rows[0]
    assert (row.tweet_id, row.news_id, row.text, row.likes, row.is_root) == ("7", "1", "a, b", None, True)
    assert row.timestamp.microsecond == 619675


def test_edges_csv(spark, tmp_path):
    path = write(tmp_path / "edges.csv", "source,target,timestamp\na,b,2025-05-26 21:20:15.619675\n")
    assert readers.read_edges(spark, path).columns == ["source", "target", "timestamp"]
    assert readers.read_edges(spark, path).count() == 1
    empty = write(tmp_path / "empty.csv", "source,target,timestamp")
    assert readers.read_edges(spark, empty).count() == 0
    named = write(tmp_path / "named.csv", "source,target,timestamp,news_id\n1,2,2025-05-26 00:00:00,3\n")
    row = readers.read_edges(spark, named).first()
    assert (row.source, row.target, row.news_id) == ("1", "2", "3")


def test_users_csv(spark, tmp_path):
    path = write(tmp_path / "users.csv", "user_id,user_type,followers,following,verified,credibility\nu,bot,1,2,false,0.25\n")
    row = readers.read_users(spark, path).first()
    assert (row.followers, row.verified, row.credibility) == (1, False, 0.25)


def test_patterns(spark, tmp_path):
    patterns = [
        {"num_nodes": 4, "propagation_tree": {"0": ["a"], "1": ["b", "c"], "2": ["d"]}},
        {"is_fake": False, "num_nodes": 2, "propagation_tree": {"0": ["a"]}},
        {"is_fake": True, "num_nodes": 1},
    ]
    path = write(tmp_path / "patterns.json", json.dumps(patterns))
    found = {(r.is_fake, r.num_nodes): tuple(r)[3:] for r in readers.read_patterns(spark, path).collect()}
    assert found == {(True, 4): (1, 2, 1), (False, 2): (1, None, None), (True, 1): (None, None, None)}
    lines = write(tmp_path / "patterns.jsonl", "\n".join(map(json.dumps, patterns)))
    assert readers.read_patterns(spark, lines, lines=True).count() == 3
    assert readers.read_patterns(spark, str(tmp_path / "absent.json")).count() == 0
    assert readers.read_patterns(spark, None).count() == 0


def test_graphs_are_reused(spark, tmp_path):
    def tables(n):
        one = spark.range(n).selectExpr("concat('g', id) as news_id")
        return {"nodes": one, "edges": one, "graphs": one}

    path = str(tmp_path / "graphs")
    assert writers.write_graphs(tables(3), path)["graphs"].count() == 3
    assert writers.write_graphs(tables(5), path)["graphs"].count() == 3
    assert writers.write_graphs(tables(5), path, overwrite=True)["graphs"].count() == 5


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("concat('g', id % 10) as news_id", "id")
    a, b = writers.save_bucketed(df, "left_side", 4), writers.save_bucketed(df, "right_side", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "news_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    spark.sql("drop table left_side")
    spark.sql("drop table right_side")


def test_metrics_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for run in ("r1", "r2"):
        writers.append_metrics(
            spark.createDataFrame([(run, "m", "f1", 0.5), (run, "m", "auc", 0.7)], "run string, model string, metric string, value double"),
            path,
        )
    rows = writers.results_table(spark.read.parquet(path), ["f1", "auc", "time"]).orderBy("run").collect()
    assert [tuple(r) for r in rows] == [("r1", "m", 0.5, 0.7, None), ("r2", "m", 0.5, 0.7, None)]


def test_csv_keeps_microseconds(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1).select(F.timestamp_micros(F.lit(1_700_000_000_123_456)).alias("timestamp"), F.lit("a").alias("source"), F.lit("b").alias("target"))
    writers.write_csv(df, path)
    assert readers.read_edges(spark, path).select(F.unix_micros("timestamp")).first()[0] == 1_700_000_000_123_456


def test_scratch_is_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and path != scratch_path(spark, "x")
    stored = materialise(spark.range(3))
    assert stored.count() == 3 and spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]
    assert materialise(spark.range(0)).count() == 0


def test_csv_keeps_line_breaks_quotes_and_commas(spark, tmp_path):
    import csv

    from ripplegraph.sources.readers import read_tweets
    from ripplegraph.sources.writers import write_csv

    texts = ['two\nlines, "quoted"', 'plain', 'ends with "', "a,b\r\nc"]
    with open(tmp_path / "tweets.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["tweet_id", "user_id", "text", "timestamp", "label", "news_id"])
        out.writerows([f"t{i}", "u", text, "2024-01-01 00:00:00", 1, "n1"] for i, text in enumerate(texts))
    read = read_tweets(spark, str(tmp_path / "tweets.csv"))
    assert [r["text"].replace("\r\n", "\n") for r in read.orderBy("tweet_id").collect()] == [t.replace("\r\n", "\n") for t in texts]
    write_csv(read, str(tmp_path / "again"))
    again = read_tweets(spark, str(tmp_path / "again"))
    assert sorted(r["text"].replace("\r\n", "\n") for r in again.collect()) == sorted(t.replace("\r\n", "\n") for t in texts)
    assert {(r["label"], r["news_id"]) for r in again.collect()} == {(1, "n1")}


def test_csv_row_that_does_not_fit_raises(spark, tmp_path):
    from ripplegraph.sources.readers import read_edges

    (tmp_path / "edges.csv").write_text("source,target,timestamp\na,b,not a time\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        read_edges(spark, str(tmp_path / "edges.csv")).collect()
