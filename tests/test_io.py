import datetime
import gzip
import json

import fake_pages
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import api
from tidewater.operators.normalize import (
    actor_rows, application_rows, handler_name, is_crypto, normalize_news, normalize_ticks, symbol_candidates, unwrap_rows,
)
from tidewater.session import scratch_path
from tidewater.sinks import catalog, lake, outputs
from tidewater.sources import candidates, envelope, files, jdbc, rest
from tidewater.streaming import outputs as stream_outputs
from tidewater.streaming import windows


# --- files -----------------------------------------------------------------------------------------


def test_csv_with_path_columns(spark, tmp_path):
    folder = tmp_path / "OHLC" / "BTC"
    folder.mkdir(parents=True)
    with gzip.open(folder / "day.csv.gz", "wt") as out:
        out.write("timestamp,open,high,low,close,volume\n1,1,2,0.5,1.5,10\n2,1,2,x,1.5,10\n")
    df = files.ohlc_files(str(tmp_path / "OHLC" / "*" / "*.gz")).read(spark)
    got = rows(df.withColumn("symbol", F.regexp_extract("path", files.OHLC_PATH, 1)), "timestamp")
    assert [(r["symbol"], r["timestamp"], r["low"]) for r in got] == [("BTC", 1, 0.5), ("BTC", 2, None)]


def test_json_and_filing_paths(spark, tmp_path):
    news = tmp_path / "News" / "ACME"
    news.mkdir(parents=True)
    (news / "news.json").write_text(json.dumps([{"headline": "h", "id": 5, "extra": 1}, {"headline": "g"}]))
    got = rows(files.news_files(str(tmp_path / "News/*/news.json"), multi_line=True).read(spark), "headline")
    assert [(r["headline"], r["id"]) for r in got] == [("g", None), ("h", 5)]
    filing = tmp_path / "ACME" / "10-Q" / "0001"
    filing.mkdir(parents=True)
    (filing / "full-submission.txt").write_text("line one\nline two\n")
    (doc,) = rows(files.whole_documents(str(tmp_path / "*/10-Q/*/full-submission.txt")).read(spark))
    assert doc["value"] == "line one\nline two\n"
    keyed = files.whole_documents(str(tmp_path / "*/10-Q/*/full-submission.txt")).read(spark).select(
        F.regexp_extract("path", files.FILING_PATH, 1).alias("company"), F.regexp_extract("path", files.FILING_PATH, 2).alias("filing")
    )
    assert rows(keyed) == [{"company": "ACME", "filing": "0001"}]
    assert files.text_lines(str(filing)).read(spark).count() == 2


def test_no_match_is_empty_and_unknown_format_fails(spark, tmp_path):
    df = files.ohlc_files(str(tmp_path / "none" / "*.gz")).read(spark)
    assert df.count() == 0 and df.columns[-1] == "path"
    with pytest.raises(ValueError, match="unsupported"):
        files.FileSource(("x",), "xml").read(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.FileSource((str(tmp_path / "none"),), "parquet").read(spark)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from tidewater.plans.catalog import QUERIES

    plan = QUERIES["s01_parquet_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_returnflag" not in plan.split("ReadSchema")[-1]


# --- message envelope --------------------------------------------------------------------------------


def test_message_source_options_and_validation():
    source = envelope.MessageSource("b:9092", ("a", "b"), "g", "latest", consumer_config={"session.timeout.ms": 6000})
    options = source.options()
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "100"
    assert options["kafka.session.timeout.ms"] == "6000"
    assert envelope.MessageSource("b", ("t",)).auto_offset_reset == "earliest"
    with pytest.raises(ValueError):
        envelope.MessageSource("b", ())
    with pytest.raises(ValueError):
        envelope.MessageSource("b", ("t",), auto_offset_reset="never")


def message_frame(spark, *data):
    return spark.createDataFrame(
        [(k, v, "t", 0, i, 77, kind) for i, (k, v, kind) in enumerate(data)],
        "key binary, value binary, topic string, partition int, offset bigint, timestamp bigint, timestampType int",
    )


def test_decode(spark):
    df = message_frame(spark, (b"key1", b'{"id": 1}', -1), (b"", b"\xff\xfeplain", 0), (None, b"[1]", 1))
    got = rows(envelope.decode(df).withColumn("id", F.try_variant_get("value_json", "$.id", "int")).drop("value_json"), "offset")
    assert (got[0]["key"], got[0]["id"], got[0]["timestamp"]) == ("key1", 1, None)
    assert got[1]["key"] is None and got[1]["value_text"].endswith("plain") and "�" in got[1]["value_text"]
    assert got[2]["timestamp"] == 77


def test_user_decoder_errors_are_kept_apart(spark):
    df = message_frame(spark, (None, b"5", 0), (None, b"x", 0))
    got = rows(envelope.decode_with(df, lambda raw: str(int(raw) * 2)), "offset")
    assert got[0]["decoded"] == "10" and got[0]["decode_error"] is None
    assert got[1]["decoded"] is None and got[1]["decode_error"].startswith("ValueError")


def test_flatten_payload_wins(spark):
    df = message_frame(spark, (b"k", b'{"kafka_topic": "mine", "a": 1}', 0), (b"k", b"[1]", 0), (b"k", b"nope", 0))
    (got,) = rows(envelope.flatten(df, "kafka_topic string, a int"))
    assert got["kafka_topic"] == "mine" and got["a"] == 1 and got["kafka_key"] == "k"


# --- payload normalising -----------------------------------------------------------------------------


def ticks_of(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    return {r["i"]: r for r in rows(normalize_ticks(df, keep=("i",), now_ms=F.lit(99)))}


def test_tick_shapes(spark):
    got = ticks_of(
        spark,
        '{"e":"trade","p":"1.5","q":"2","T":7,"E":9,"s":"btcusdt"}',
        '{"data":{"p":3,"q":0,"T":0,"E":8,"s":"ethusd"},"price":1}',
        '{"price":0,"p":3,"volume":0,"q":null,"v":4}',
        '{"price":"0","p":3,"timestamp":5,"symbol":"x"}',
        '{"volume":1}',
        '{"e":"trade","price":5}',
        "not json",
        "[1]",
        '{"close":0,"timestamp":"12"}',
        '{"price":"abc"}',
        '{"data":{},"price":2}',
        '{"data":[1],"price":2,"volume":"much"}',
        '{"price":false,"close":6}',
    )
    tick = lambda i: tuple(got[i][c] for c in ("symbol", "close", "volume", "timestamp", "valid"))
    assert tick(0) == ("BTCUSDT", 1.5, 2.0, 7, True)
    assert tick(1) == ("ETHUSD", 3.0, 0.0, 8, True)
    assert tick(2) == ("BTCUSDT", 3.0, 4.0, 99, True)
    assert tick(3) == ("X", 0.0, 0.0, 5, True)
    assert tick(8) == ("BTCUSDT", 0.0, 0.0, 12, True)
    assert got[9]["valid"] is False and got[11]["valid"] is False
    assert tick(10)[1] == 2.0 and tick(12)[1] == 6.0
    assert {4, 5, 6, 7}.isdisjoint(got)


def test_unwrapping(spark):
    df = spark.createDataFrame(
        [(0, '[{"id":1},{"id":2}]'), (1, '{"items":[{"id":3}],"next":null}'), (2, '{"results":"x","data":[{"id":4}]}'), (3, '{"id":5}'), (4, "7"), (5, '{"data":[]}')],
        "i int, payload string",
    )
    got = rows(unwrap_rows(df).select("i", "ordinal", F.variant_get("record", "$.id", "int").alias("id")), "i", "ordinal")
    assert [(r["i"], r["id"]) for r in got] == [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)]


def test_news(spark):
    df = spark.createDataFrame(
        [("A", '{"news":[{"headline":"","title":" t ","site":"s","link":"u","date":"d"},{"url":"no headline"},{"text":"x","published_at":0,"datetime":5}]}')],
        "symbol string, payload string",
    )
    got = rows(normalize_news(df, now_s=F.lit(1)), "ordinal")
    assert [(r["headline"], r["source"], r["url"], r["published_at"]) for r in got] == [("t", "s", "u", "d"), ("x", "live", "", "5")]


def test_symbols(spark):
    df = spark.createDataFrame([("BTCUSD",), ("btcusdt ",), ("ACME",), ("",)], "s string")
    got = [r["c"] for r in df.select(symbol_candidates(F.col("s")).alias("c")).collect()]
    assert got == [["BTCUSD", "BTCUSDT", "BTC", "BTC-USD"], ["BTCUSDT", "BTC", "BTCUSD"], ["ACME"], ["BTCUSDT", "BTC", "BTCUSD"]]
    assert [r["c"] for r in df.select(is_crypto(F.col("s")).alias("c")).collect()] == [True, True, False, False]
    named = spark.createDataFrame([("", "a.b-c"), ("x", "y"), (None, None)], "t string, p string")
    assert [r["h"] for r in named.select(handler_name(F.col("t"), F.col("p")).alias("h")).collect()] == ["handle_a_b_c", "handle_x", None]


def test_application_payload_shapes(spark):
    as_map = {"applications": {"one": {"status": "RUNNING", "deployments": {"d": {"status": {"status": "healthy"}, "replica_states": {"RUNNING": 2}}}}}}
    as_list = {"data": {"applications": [{"name": " two ", "app_status": "deploying", "deployments": [
        {"deployment_name": "d", "state": "updating", "replicas": [{"state": "starting"}, {"status": "RUNNING"}, {"state": ""}]}]}, {"name": " "}]}}
    df = spark.createDataFrame([(json.dumps(as_map),), (json.dumps(as_list),), ("x",)], "payload string")
    apps, replicas = application_rows(df.withColumn("n", F.monotonically_increasing_id()), key="n")
    assert [(r["name"], r["app_status"], r["deployment_states"]) for r in rows(apps, "name")] == [
        ("one", "RUNNING", ["HEALTHY"]), ("two", "DEPLOYING", ["UPDATING"])
    ]
    assert [(r["name"], r["state"], r["n"]) for r in rows(replicas, "name", "state")] == [("one", "RUNNING", 2), ("two", "RUNNING", 1), ("two", "STARTING", 1)]


def test_payloads_with_the_same_application_stay_apart(spark):
    one = {"applications": {"app": {"status": "RUNNING", "deployments": {"d": {"status": "HEALTHY", "replica_states": {"RUNNING": 2}}}}}}
    two = {"applications": [{"name": "app", "status": "DEPLOYING", "deployments": [{"name": "d", "status": "UPDATING", "replica_states": {"RUNNING": 1}}]}]}
    df = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, json.dumps({"name": "solo", "status": "running"}))], "k int, payload string")
    apps, replicas = application_rows(df, key="k")
    assert [(r["doc"], r["name"], r["app_status"], r["deployment_states"]) for r in rows(apps, "doc")] == [
        (1, "app", "RUNNING", ["HEALTHY"]), (2, "app", "DEPLOYING", ["UPDATING"]), (3, "solo", "RUNNING", None)
    ]
    assert [(r["doc"], r["state"], r["n"]) for r in rows(replicas, "doc")] == [(1, "RUNNING", 2), (2, "RUNNING", 1)]


def test_a_quoted_twin_key_elsewhere_does_not_count(spark):
    payloads = [
        '{"price":0,"p":3,"meta":{"price":"x"}}', '{"price":"0","p":3}', '{"data":{"s":"","p":"2","T":0,"E":5},"s":"outer","T":"0"}',
        '{"e":"trade","p":"1.5","q":"2","T":7,"s":"btcusdt"}',
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    got = rows(normalize_ticks(df, now_ms=F.lit(9), keep=("i",)), "i")
    assert [(r["close"], r["symbol"], r["timestamp"]) for r in got] == [
        (3.0, "BTCUSDT", 9), (0.0, "BTCUSDT", 9), (2.0, "BTCUSDT", 5), (1.5, "BTCUSDT", 7)
    ]


def test_actor_payload_shapes(spark):
    old = {"data": {"actors": {"a1": {"name": "ServeReplica:app:dep#1", "className": "C", "state": "ALIVE", "pid": 3}}}}
    new = {"data": {"result": {"result": [{"actor_id": "a2", "class_name": "D"}, 5]}}}
    df = spark.createDataFrame([(json.dumps(old),), (json.dumps(new),)], "payload string")
    got = rows(actor_rows(df), "actor_id")
    assert [(r["actor_id"], r["class_name"], r["state"], r["app_name"]) for r in got] == [("a1", "C", "ALIVE", "app"), ("a2", "D", "UNKNOWN", None)]


# --- REST, JDBC, candidates ----------------------------------------------------------------------------


@pytest.mark.parametrize("tasks", [1, 2, 5])
def test_paged_rest(spark, tasks):
    spark.sparkContext.addPyFile(fake_pages.__file__)
    read = lambda **more: rest.rest_records(spark, url="http://example.invalid/x", pagination="page", numPartitions=tasks, **more)
    got = rows(read(fetcher="fake_pages:fetch"), "page", "ordinal")
    assert [json.loads(r["record"])["id"] for r in got] == [1, 2, 3, 4]
    # pages behind the first empty one do not count
    assert sorted(r["page"] for r in rows(read(fetcher="fake_pages:with_gap"))) == [1, 2]
    for pages in (0, 1, 2, 21):
        got = rows(read(fetcher="fake_pages:many", pages=pages))
        assert sorted(json.loads(r["record"])["id"] for r in got) == list(range(2, 2 * pages + 2))


def test_rest_pages_are_dealt_evenly_with_few_requests(monkeypatch):
    waits = []
    monkeypatch.setattr(rest.time, "sleep", waits.append)
    options = {"url": "http://example.invalid/x", "pagination": "page", "fetcher": "fake_pages:many", "pages": "1000", "rate_limit_delay": "0.5"}
    reader = rest.PagedRestReader(options | {"numPartitions": "7"})
    fake_pages.ASKED.clear()
    parts = reader.partitions()
    assert len(fake_pages.ASKED) == len(waits) <= 21 and set(waits) == {0.5}
    assert [p.first for p in parts[1:]] == [p.end for p in parts[:-1]] and (parts[0].first, parts[-1].end) == (1, 1001)
    assert {p.end - p.first for p in parts} <= {142, 143}
    waits.clear()
    assert sum(1 for _ in reader.read(parts[3])) == 2 * (parts[3].end - parts[3].first)
    assert set(waits) == {3.5}  # seven tasks share the rate


def test_rest_single_request_and_errors(spark):
    spark.sparkContext.addPyFile(fake_pages.__file__)
    spark.dataSource.register(rest.PagedRestSource)
    base = spark.read.format("paged_rest").option("url", "http://example.invalid/x")
    assert [json.loads(r["record"]) for r in rows(base.option("fetcher", "fake_pages:fetch").load())] == [{"id": 9}]
    with pytest.raises(Exception, match="source is down"):
        base.option("fetcher", "fake_pages:failing").load().count()
    with pytest.raises(Exception, match="scheme"):
        spark.read.format("paged_rest").option("url", "nowhere").load().count()


def test_rest_retries_lost_connections_with_a_timeout(monkeypatch):
    import io
    import urllib.error

    seen, answers = [], [urllib.error.URLError("lost"), TimeoutError("hung"), ConnectionResetError("reset"), io.BytesIO(b"[1]")]

    def answer(request, timeout):
        seen.append(timeout)
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    monkeypatch.setattr(rest.urllib.request, "urlopen", answer)
    monkeypatch.setattr(rest.time, "sleep", lambda seconds: None)
    assert rest.http_fetch({"url": "http://example.invalid/x", "retries": "3", "timeout": "7"}, {}) == [1] and seen == [7.0] * 4
    answers[:] = [urllib.error.URLError("lost")] * 2
    with pytest.raises(urllib.error.URLError):
        rest.http_fetch({"url": "http://example.invalid/x", "retries": "1"}, {})


def test_rest_auth():
    assert rest.auth_headers({"auth_type": "bearer", "auth_token": "t"}) == {"Authorization": "Bearer t"}
    assert rest.auth_headers({"auth_type": "header", "auth_key": "X", "auth_token": "t"}) == {"X": "t"}
    assert rest.auth_headers({"auth_type": "basic", "auth_username": "u", "auth_password": "p"}) == {"Authorization": "Basic dTpw"}
    assert rest.auth_headers({}) == {}


def test_sql_source_options():
    plain = jdbc.SqlSource("jdbc:x:y", "SELECT 1").options()
    assert plain == {"url": "jdbc:x:y", "fetchsize": "1000", "query": "SELECT 1"}
    split = jdbc.SqlSource("jdbc:x:y", "SELECT 1", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3).options()
    assert split["dbtable"] == "(SELECT 1) q" and split["numPartitions"] == "3" and "query" not in split
    with pytest.raises(ValueError):
        jdbc.SqlSource("u", "SELECT 1", partition_column="id").options()
    with pytest.raises(ValueError):
        jdbc.SqlSource("u", " ").options()


def test_table_endpoint_allow_list(spark):
    with pytest.raises(ValueError, match="not allowed"):
        jdbc.table_endpoint({"a": spark.range(1)}, "b", ["id"], 5)


def test_fallback(spark):
    live = spark.createDataFrame([("A", 1.0)], "symbol string, close double")
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = rows(candidates.with_fallback(live, wanted, candidates.fallback_prices(wanted, F.lit(10_000_000)), F.lit("down")), "symbol", "id")
    assert sum(r["symbol"] == "A" for r in got) == 1 and sum(r["symbol"] == "B" for r in got) == 25
    first = next(r for r in got if r["id"] == 0)
    assert (first["close"], first["volume"], first["timestamp"], first["source_error"]) == (68280.0, 1.1, 10_000_000 - 25 * 60_000, "down")


# --- sinks -----------------------------------------------------------------------------------------


def test_catalog_types():
    schema = T.StructType([
        T.StructField(n, t) for n, t in {
            "a": T.LongType(), "b": T.StringType(), "c": T.BooleanType(), "d": T.DecimalType(10, 2), "e": T.ArrayType(T.LongType()),
            "f": T.ShortType(), "g": T.FloatType(), "h": T.TimestampNTZType(), "i": T.DateType(), "j": T.BinaryType(), "k": T.DoubleType(),
        }.items()
    ])
    data, parts = catalog.catalog_columns(schema, ("b",))
    assert parts == [("b", "string")]
    assert dict(data) == {"a": "bigint", "c": "boolean", "d": "string", "e": "string", "f": "int", "g": "float", "h": "timestamp", "i": "date", "j": "binary", "k": "double"}


def test_catalog_rows(spark):
    assert [(r["name"], r["type"]) for r in rows(catalog.catalog_rows(spark.range(1).selectExpr("id", "array(id) a")), "ordinal")] == [("id", "bigint"), ("a", "string")]


def test_register_once_and_list(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, p string")
    lake.write_table(df, str(tmp_path / "t"), "overwrite", ("p",))
    assert catalog.register_table(spark, "shop.t", str(tmp_path / "t"), df.schema, ("p",)) is True
    assert catalog.register_table(spark, "shop.t", str(tmp_path / "t"), df.schema, ("p",)) is False
    assert rows(spark.table("shop.t"), "id") == [{"id": 1, "p": "x"}, {"id": 2, "p": "y"}]
    listed = api.list_tables(spark, "shop", keep_seconds=0)
    assert listed["source"] == "catalog" and listed["tables"][0][0] == "t" and str(tmp_path) in listed["tables"][0][1]
    assert api.get_schema(spark, "shop.t") == [("id", "int"), ("p", "string")]
    assert api.preview(spark, "shop.t", 1).count() == 1
    missing = api.list_tables(spark, "nowhere", (("a", "b"),))
    assert missing["source"] == "fallback" and missing["tables"] == [("a", "b")]


def test_time_zone_strip(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 12), 1)], "t timestamp, x int")
    out = lake.strip_time_zone(df)
    assert out.schema["t"].dataType == T.TimestampNTZType() and out.first()["t"] == datetime.datetime(2024, 1, 1, 12)


def test_schema_evolution_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_table(spark.createDataFrame([(1,)], "a int"), path, "overwrite")
    lake.write_table(spark.createDataFrame([(2, "x")], "a int, b string"), path, "append")
    assert rows(lake.read_table(spark, path), "a") == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    lake.write_table(spark.createDataFrame([(3,)], "a int"), path, "overwrite")
    assert lake.read_table(spark, path).columns == ["a"]
    with pytest.raises(ValueError):
        lake.write_table(spark.range(1), path, "merge")


def test_log_table_expires_whole_days(spark, tmp_path):
    columns = "time timestamp, component string, level string, message string, trace_id string, agent_name string, metadata string"
    log = lambda *days: spark.createDataFrame(
        [(datetime.datetime(2024, 1, d, 23, 59), "c", "INFO", "m", "t", "a", "{}") for d in days], columns
    )
    path = str(tmp_path / "logs")
    lake.append_logs(log(1, 2, 3), path, 0)
    lake.append_logs(log(3, 4), path, 1)
    lake.append_logs(log(3, 4), path, 1)  # a replay
    assert spark.read.parquet(path).count() == 5
    assert lake.expire_days(spark, path, datetime.date(2024, 2, 2)) == ["day=2024-01-01", "day=2024-01-02"]
    left = rows(spark.read.parquet(path), "day", "batch_id")
    assert [(str(r["day"]), r["batch_id"]) for r in left] == [("2024-01-03", 0), ("2024-01-03", 1), ("2024-01-04", 1)]
    assert lake.expire_days(spark, path, datetime.date(2024, 2, 2)) == []


def test_failed_batch_reaches_dead_letters(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    message = lake.write_or_dead_letter(spark.range(3), str(blocked / "t"), str(tmp_path / "dlq"), mode="append")
    assert message
    dead = spark.read.parquet(str(tmp_path / "dlq"))
    assert dead.count() == 3 and dead.first()["dlq_error"] == message
    assert lake.write_or_dead_letter(spark.range(3), str(tmp_path / "ok"), str(tmp_path / "dlq"), mode="append") is None


def test_http_payload_forms(spark):
    df = spark.createDataFrame([(2,), (1,), (3,)], "v int").coalesce(1)
    bare = rows(outputs.http_payloads(df, None, size=2), "batch")
    assert [json.loads(r["payload"]) for r in bare] == [[{"v": 1}, {"v": 2}], [{"v": 3}]]
    keyed = rows(outputs.http_payloads(df, "rows", metadata=False, size=2), "batch")
    assert json.loads(keyed[1]["payload"]) == {"rows": [{"v": 3}]}
    many = outputs.http_payloads(spark.range(1050).repartition(3))
    assert many.filter("count > 100").count() == 0 and many.agg(F.sum("count")).first()[0] == 1050
    numbered = rows(outputs.batch_numbers(spark.range(10).coalesce(1), 4), "id")
    assert [r["batch"] for r in numbered] == [0] * 4 + [1] * 4 + [2] * 2


def test_post_partitions(spark, tmp_path):
    target = str(tmp_path)

    def post(payload):
        import uuid

        with open(f"{target}/{uuid.uuid4().hex}.json", "w") as out:
            json.dump(payload, out)

    outputs.post_partitions(spark.range(5).coalesce(1), post, 2, "records")
    sent = sorted((json.loads(p.read_text())["records"] for p in tmp_path.glob("*.json")), key=str)
    assert sorted(len(s) for s in sent) == [1, 2, 2] and sorted(r["id"] for s in sent for r in s) == [0, 1, 2, 3, 4]
    outputs.post_partitions(spark.range(0), post, 2)
    assert len(list(tmp_path.glob("*.json"))) == 3


def test_http_poster(monkeypatch):
    import contextlib
    import urllib.request

    seen = []

    def open_request(request, timeout):
        seen.append((request.get_method(), request.full_url, request.headers, json.loads(request.data), timeout))
        return contextlib.nullcontext()

    monkeypatch.setattr(urllib.request, "urlopen", open_request)
    outputs.http_poster("http://example.invalid/in", auth_type="bearer", auth_token="t", timeout=5)([{"a": 1}])
    ((method, url, headers, body, timeout),) = seen
    assert (method, url, body, timeout) == ("POST", "http://example.invalid/in", [{"a": 1}], 5)
    assert headers["Authorization"] == "Bearer t"

    def refuse(request, timeout):
        raise OSError("refused")

    monkeypatch.setattr(urllib.request, "urlopen", refuse)
    outputs.http_poster("http://example.invalid/in", raise_on_error=False)([])
    with pytest.raises(OSError):
        outputs.http_poster("http://example.invalid/in")([])


def test_vector_validation(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), (None,)], "e array<double>")
    assert [r["valid"] for r in outputs.vector_rows(df, "e", 2).collect()] == [True, False, False, False]


def test_vector_batches_are_bounded(spark):
    df = spark.range(2500).select("id", F.array(F.lit(1.0), F.when(F.col("id") % 2 == 0, 2.0)).alias("e"))
    sizes = [r["count"] for r in rows(outputs.vector_batches(df, "e", 2).groupBy("part", "batch").count())]
    assert sum(sizes) == 1250 and max(sizes) <= outputs.VECTOR_BATCH


def test_sql_write_with_ddl_and_conflict_clause(spark, monkeypatch):
    """Statement texts and their order; no database is involved."""
    from pyspark.sql.readwriter import DataFrameWriter

    done = []
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, url, table, mode=None, properties=None: done.append(f"write {table}"))
    df = spark.createDataFrame([(1, [2])], 'id int, "a" array<int>'.replace('"', "`"))
    outputs.write_jdbc(df, "jdbc:x", "t", ddl="CREATE TABLE t", conflict="ON CONFLICT DO NOTHING", execute=done.append)
    staged = done[1].removeprefix("write ")
    assert staged.startswith('"public"."t_staged_')
    assert done == [
        "CREATE TABLE t", f"write {staged}",
        f'INSERT INTO "public"."t" ("id","a") SELECT "id","a" FROM {staged} ON CONFLICT DO NOTHING', f"DROP TABLE IF EXISTS {staged}",
    ]
    done.clear()
    outputs.write_jdbc(df, "jdbc:x", "t")
    assert done == ["write t"]
    with pytest.raises(ValueError):
        outputs.write_jdbc(df, "jdbc:x", "t", conflict="ON CONFLICT DO NOTHING")
    assert outputs.insert_from("s", 'we"ird', ["c"]) == 'INSERT INTO "public"."we""ird" ("c") SELECT "c" FROM "public"."s"'


def test_audit_codes(spark):
    names = [None, "PermissionError", "DomainNotFoundError", "ActionNotFoundError", "ValueError", "CircuitOpenError", "KeyError"]
    df = spark.createDataFrame([(n,) for n in names], "e string")
    assert [r["c"] for r in df.select(outputs.audit_status(F.col("e")).alias("c")).collect()] == [200, 403, 404, 422, 400, 503, 500]


# --- streams -----------------------------------------------------------------------------------------


def land(spark, path, batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")


TICK = "symbol string, close double, volume double, timestamp bigint, id bigint"


def tick_batches():
    import random

    rng = random.Random(5)
    out, i = [], 0
    for b in range(4):
        batch = []
        for _ in range(60):
            i += 1
            batch.append(("hot" if rng.random() < 0.6 else f"s{rng.randrange(3)}", round(rng.uniform(1, 5), 2), float(rng.randrange(4)), 1000 * rng.randrange(b * 30, b * 30 + 60), i))
        out.append(batch)
    return out


def test_stream_windows_equal_batch_over_many_batches(spark, tmp_path):
    from tidewater.operators.market import keyed_window_counts

    batches = tick_batches()
    land(spark, str(tmp_path / "in"), batches, TICK)
    with_ts = lambda df: df.withColumn("ts", F.timestamp_millis("timestamp"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = with_ts(windows.landing_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1))
    counts = windows.windowed_counts(stream, lateness="1 day")
    query = windows.drain(counts, str(tmp_path / "cp"), windows.batch_writer(str(tmp_path / "out")), "update")
    got = rows(windows.newest_per_key(spark, str(tmp_path / "out"), counts.schema, ["time", "symbol"]), "time", "symbol")
    want = rows(keyed_window_counts(with_ts(spark.createDataFrame([r for b in batches for r in b], TICK))), "time", "symbol")
    assert [(r["time"], r["symbol"], r["count"]) for r in got] == [(r["time"], r["symbol"], r["count"]) for r in want]
    assert all(g["avg_price"] == pytest.approx(w["avg_price"]) for g, w in zip(got, want))
    progress = rows(stream_outputs.progress_rows(spark, query), "batch_id")
    assert sum(r["input_rows"] for r in progress) == 240 and not progress[0]["running"]


def test_stream_state_equals_batch_after_every_batch(spark, tmp_path):
    from tidewater.operators.market import market_state, newest_rows

    batches = tick_batches()
    land(spark, str(tmp_path / "in"), batches, TICK)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.landing_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    path = str(tmp_path / "out")
    windows.drain(stream, str(tmp_path / "cp"), windows.newest_tick_windows(path))
    assert all(len(v) <= 2 for v in windows.state_versions(spark, path).values())  # older versions are gone
    windows.newest_tick_windows(path)(spark.createDataFrame(batches[3], TICK), 3)  # a replay changes nothing
    got = rows(windows.window_metrics(windows.latest_state(spark, path)), "symbol")
    everything = spark.createDataFrame([r for b in batches for r in b], TICK)
    want = rows(market_state(newest_rows(everything, "symbol", ["timestamp", "id"])), "symbol")
    totals = {r["symbol"]: r["n"] for r in rows(everything.groupBy("symbol").agg(F.count("*").alias("n")))}
    for g, w in zip(got, want, strict=True):
        assert g["tick_count"] == totals[g["symbol"]]
        for name, value in w.items():
            assert g[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_late_rows_are_kept_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "routes")
    write = windows.counts_with_late_rows(path)
    at = lambda rows: spark.createDataFrame(rows, "s bigint, symbol string, close double").select(F.timestamp_seconds("s").alias("ts"), "symbol", "close")
    first = at([(1000, "a", 1.0), (1009, "a", 3.0), (1200, "b", 5.0), (1001, "", 1.0), (1002, "a", None)])
    second = at([(1139, "a", 9.0), (1140, "b", 9.0), (1135, "a", 7.0), (500, "a", 1.0), (None, "a", 1.0)])
    write(first, 0), write(second, 1), write(second, 1)
    dead = spark.read.parquet(f"{path}/dead")
    assert sorted((r["batch_id"], r["reason"], r["close"]) for r in rows(dead) if r["close"]) == [
        (0, "unusable", 1.0), (1, "late", 1.0), (1, "late", 7.0), (1, "late", 9.0), (1, "unusable", 1.0)
    ]  # windows that ended at 1140 or before are late: the newest row before was 1200
    counted = rows(windows.counted_windows(spark, path), "time", "symbol")
    assert [(r["time"], r["symbol"], r["avg_price"], r["count"]) for r in counted] == [
        (1_000_000, "a", 2.0, 2), (1_140_000, "b", 9.0, 1), (1_200_000, "b", 5.0, 1)
    ]
    assert sum(r["count"] for r in counted) + dead.count() == 10


def test_a_batch_rewrites_only_buckets_of_its_symbols(spark, tmp_path):
    path = str(tmp_path / "state")
    write = windows.newest_tick_windows(path, buckets=16)
    schema = "symbol string, timestamp bigint, id bigint, close double, volume double"
    write(spark.createDataFrame([(f"s{i}", t, t, 1.0, 1.0) for i in range(40) for t in range(3)], schema), 0)
    first = windows.state_versions(spark, path)
    assert len(first) > 10 and set(map(tuple, first.values())) == {(0,)}
    for batch_id in (1, 2, 3):
        write(spark.createDataFrame([("s7", 10 + batch_id, 1, 2.0, 1.0)], schema), batch_id)
    after = windows.state_versions(spark, path)
    (touched,) = [b for b in after if after[b] != [0]]
    assert after[touched] == [2, 3]
    got = {r["symbol"]: (r["tick_count"], r["batch_count"]) for r in rows(windows.window_metrics(windows.latest_state(spark, path)))}
    assert got.pop("s7") == (6, 4) and set(got.values()) == {(3, 1)} and len(got) == 39


def test_replayed_batches_are_not_doubled(spark, tmp_path):
    batch = spark.range(5)
    write = windows.batch_writer(str(tmp_path / "a"))
    write(batch, 0), write(batch, 0), write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 10
    sink = stream_outputs.overwrite_then_append(str(tmp_path / "b"))
    sink(spark.range(3), 0), sink(batch, 1), sink(batch, 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 8
    sink(spark.range(2), 0)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [[(1,)], [(2,)]], "x int")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: windows.drain(
        windows.landing_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "cp"), windows.batch_writer(str(tmp_path / "out"))
    )
    run(), run()
    spark.createDataFrame([(3,)], "x int").write.parquet(str(tmp_path / "in" / "b=9"))
    run()
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_table_list_is_kept_for_a_minute(spark):
    now = [0.0]
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    try:
        names = lambda: [n for n, _ in api.list_tables(spark, "kept", clock=lambda: now[0])["tables"]]
        assert names() == []
        spark.range(1).write.saveAsTable("kept.one")
        assert names() == []
        now[0] = api.TABLE_LIST_SECONDS
        assert names() == ["one"]
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def test_batches_by_time(spark, tmp_path):
    """A time trigger takes what has landed and goes on until it is stopped."""
    land(spark, str(tmp_path / "in"), [[(1,)], [(2,)]], "x int")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.landing_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    query = windows.run_every(stream, str(tmp_path / "cp"), windows.batch_writer(str(tmp_path / "out")), "100 milliseconds")
    try:
        query.processAllAvailable()
        spark.createDataFrame([(3,)], "x int").coalesce(1).write.parquet(str(tmp_path / "in" / "b=9"))
        query.processAllAvailable()
        assert windows.data_batches(query) == 3 and query.isActive
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["x"], r["batch_id"]) for r in out.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_late_rows_are_dropped(spark, tmp_path):
    """A batch drops rows older than the watermark its predecessor ran with."""
    land(spark, str(tmp_path / "in"), [[("A", 1.0, 0)], [("A", 1.0, 1000)], [("A", 3.0, 1001)], [("A", 5.0, 1)], [("A", 1.0, 2000)]], "symbol string, close double, s bigint")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.landing_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1).withColumn("ts", F.timestamp_seconds("s"))
    counts = windows.windowed_counts(stream)
    windows.drain(counts, str(tmp_path / "cp"), windows.batch_writer(str(tmp_path / "out")))
    got = rows(spark.read.schema(counts.schema).parquet(str(tmp_path / "out")), "time")
    assert [(r["time"], r["avg_price"], r["count"]) for r in got] == [(0, 1.0, 1), (1_000_000, 2.0, 2)]


def test_one_failing_sink_does_not_stop_the_other(spark, tmp_path):
    def broken(batch, batch_id):
        raise RuntimeError("down")

    good = windows.batch_writer(str(tmp_path / "good"))
    status = stream_outputs.write_to_all(spark.range(2), 7, {"broken": ("x", broken), "good": ("y", good)})
    assert status == [(7, "broken", False, "x", "RuntimeError: down"), (7, "good", True, "y", None)]


def test_scratch_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith((shared or spark.conf.get("spark.checkpoint.dir")) + "/x-")


def test_scratch_without_a_setting_is_below_the_warehouse():
    class Unset:
        def __init__(self, found):
            self.get = lambda key, default=None: found.get(key, default)

    class Session:
        conf = Unset({"spark.sql.warehouse.dir": "hdfs://x/warehouse/"})
        sparkContext = type("Context", (), {"getConf": lambda self: Unset({})})()

    assert scratch_path(Session(), "y").startswith("hdfs://x/warehouse/_scratch/y-")


@pytest.mark.parametrize("master, allowed", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, allowed):
    class Unset:
        def __init__(self, found):
            self.get = lambda key, default=None: found.get(key, default)

    class Session:
        conf = Unset({"spark.sql.warehouse.dir": "file:/home/someone/spark-warehouse"})
        sparkContext = type("Context", (), {"getConf": lambda self: Unset({}), "master": master})()

    if allowed:
        assert scratch_path(Session(), "y").startswith("file:/home/someone/spark-warehouse/_scratch/y-")
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_path(Session(), "y")


# --- read surface ------------------------------------------------------------------------------------


def test_run_sql_envelope(spark):
    ok = api.run_sql(spark, "SELECT id, id * 2 AS d FROM range(3) ORDER BY id")
    path = ok.pop("path")
    assert ok == {"success": True, "columns": ["id", "d"], "rows": [[0, 0], [1, 2], [2, 4]], "row_count": 3, "next_page": None}
    assert api.read_result(spark, path).columns == ["id", "d"]
    paged = api.run_sql(spark, "SELECT * FROM range(5)", page_size=2)
    assert paged["row_count"] == 5 and paged["rows"] == [[0], [1]]
    seen, after = [[0], [1]], paged["next_page"]
    while after is not None:
        page = api.read_page(spark, paged["path"], after, 2)
        seen, after = seen + page["rows"], page["next_page"]
    assert seen == [[i] for i in range(5)] and api.read_result(spark, paged["path"]).count() == 5
    bad = api.run_sql(spark, "SELECT * FROM no_such_table")
    assert bad["success"] is False and bad["error_type"] == "AnalysisException" and "no_such_table" in bad["error_message"]
    with pytest.raises(ValueError):
        api.run_sql(spark, " ")


@pytest.mark.parametrize("path", ["", "x" * 257, "'); DROP TABLE users; --", "a b", "a\n"])
def test_bad_paths(path, spark):
    with pytest.raises(ValueError):
        api.check_table_path(path)
    assert spark.createDataFrame([(path,)], "p string").select(api.is_safe_path(F.col("p")).alias("ok")).first()["ok"] is False


def test_good_path():
    assert api.check_table_path("s3://bucket/a-b_c.d/x") == "s3://bucket/a-b_c.d/x"


def test_chained_transforms(spark):
    out = api.chain(spark.range(10), lambda d: d.filter("id > 5"), lambda d: d.withColumn("x", F.col("id") + 1))
    assert [r["x"] for r in out.collect()] == [7, 8, 9, 10]


def test_scorer_hook(spark):
    def load():
        import pandas as pd

        return lambda texts: pd.DataFrame({"length": texts.str.len(), "upper": texts.str.upper()})

    got = rows(api.score_with(spark.createDataFrame([("ab",), ("c",)], "t string"), "t", load, "length bigint, upper string"), "t")
    assert got == [{"t": "ab", "length": 2, "upper": "AB"}, {"t": "c", "length": 1, "upper": "C"}]
