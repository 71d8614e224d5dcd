from pyspark.sql import functions as F

from logspark.functions import events as ev
from logspark.functions import text as tx


def values(spark, rows, expr, schema="m string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


RAW = [
    "Received blk_-1234567890 from node", "Connect to 10.0.0.1:8080 failed", "At 2005-12-01-06.51.06.123456 kernel panic",
    "Node R3-M1-N1:J18-U11 down", "hdfs: datanode started", "a  b   c", "", None,
]


def test_generalize(spark):
    assert values(spark, RAW, tx.generalize(F.col("m"))) == [
        "Received <BLK> from node", "Connect to <IP> failed", "At <TS> kernel panic", "Node <NODE> down",
        "hdfs: datanode started", "a b c", "", "",
    ]


def test_generalize_order_of_patterns(spark):
    got = values(spark, ["see /a/b.log at 2005.12.01 code deadbeef99 x12 7", "\ttabs\n and lines "], tx.generalize(F.col("m")))
    assert got == ["see <PATH> at <DATE> code <HEX> x12 <NUM>", "tabs and lines"]


def test_clean(spark):
    got = values(spark, RAW[:6] + ["2005-12-01T06:51:06 UP", "HDFS.x"], tx.clean(F.col("m")))
    assert got == [
        "received [BLK] from node", "connect to [IP] failed", "at [TIMESTAMP] kernel panic", "node [NODE] down",
        "[SERVICE] datanode started", "a b c", "2005-12-01t06:51:06 up".replace("2005-12-01", "[TIMESTAMP]").replace("t06:51:06", "t06:[NUM]:[NUM]"),
        "[SERVICE] x",
    ]


def test_tokenize(spark):
    got = values(spark, ["connect to [IP]:[NUM], ok!", "...", "[ip] x"], tx.tokenize(F.col("m")))
    assert got == [["connect", "to", "[IP]", "[NUM]", "ok"], [], ["ip", "x"]]


def test_parse_line(spark):
    got = values(spark, [
        "2005-12-01 06:51:06 INFO dfs.DataNode: message here", "warn low space", "WARNING hot", "ERROR", "plain text", "  x ",
    ], tx.parse_line(F.col("m")))
    assert [tuple(r) for r in got] == [
        ("INFO", "dfs.DataNode: message here"), ("WARN", "low space"), ("WARNING", "hot"), ("", "ERROR"), ("", "plain text"), ("", "x"),
    ]


def test_parse_json(spark):
    got = values(spark, [
        '{"ts": 5, "severity": "warn", "msg": "m", "label": 1, "host": "h"}', "no json {", '{"level": "info"}',
    ], tx.parse_json(F.col("m"), "svc"))
    assert (got[0].timestamp, got[0].level, got[0].message, got[0].label, got[0].meta, got[0].service) == (5.0, "WARN", "m", 1, {"host": "h"}, "svc")
    assert (got[1].timestamp, got[1].level, got[1].message, got[1].meta) == (None, "", "no json {", {})
    assert (got[2].level, got[2].message) == ("INFO", '{"level": "info"}')


def test_keys_and_coercion(spark):
    df = spark.createDataFrame([("bgl", "s1", "1.5", 0, 7), (None, None, "x", 0, 0), ("", "s", "NaN", 4, 1)], "svc string, sid string, ts string, tok int, tid int")
    rows = df.select(
        ev.stream_key(F.col("svc"), F.col("sid")), ev.path_key(F.coalesce("svc", F.lit("d")), F.col("sid")),
        ev.safe_timestamp(F.col("ts")), ev.coalesce_token(F.col("tok"), F.col("tid")),
    ).collect()
    assert [tuple(r) for r in rows] == [("bgl:s1", "bgl/s1", 1.5, 7), ("unknown:", "d", 0.0, 1), ("unknown:s", "/s", 0.0, 4)]


def test_severity_edges(spark):
    rows = [(1.5, 1.0), (1.2, 1.0), (1.0, 1.0), (0.5, 1.0), (0.5, 0.33), (1.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, t double")
    assert [r[0] for r in df.select(ev.severity_by_ratio(F.col("s"), F.col("t"))).collect()] == [
        "critical", "high", "medium", "low", "critical", "critical"]


def test_snippet(spark):
    got = values(spark, ["x" * 101, "short", None], tx.snippet(F.lit(3), F.col("m")))
    assert got == ["tid=3: " + "x" * 100 + "...", "tid=3: short", "tid=3: <UNK>"]
