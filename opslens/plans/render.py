"""Renders the benchmark tables as log text, one projection per table.

The tables hold no log text.  These projections write it, the parsers read it back, and
the SQL checks answer from the table columns, so they do not depend on any parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.sources.lines import rows_as_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey"}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are to be rendered, spread over all cores.

    A table of many splits is spread already.  One that is a single row group is not, and
    writing and parsing its text would otherwise run in one task.  A table without a unique
    key is numbered (``row_id``) by the scan, where a lost task gives the same numbers again.
    The number of partitions is that of every shuffle of the session.
    """
    df = table(spark, sf_dir, name)
    if name not in KEYS:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEYS.get(name, "row_id"))


def text(*parts) -> Column:
    """Concatenation; strings are literals, columns are cast."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def cents(amount: Column) -> Column:
    """Money as text with two places."""
    return amount.cast("decimal(18,2)").cast("string")


def dblog_line() -> Column:
    e, user = F.col("event_id"), F.col("user_id")
    shop = text("shop", user % 4)
    k = F.get_json_object("props", "$.k")
    prefix = text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), "+0000 [conn", user, "] ")
    plan = F.when(e % 2 == 1, "COLLSCAN").otherwise("IXSCAN { uid: 1 }")
    command = F.element_at(F.array(F.lit("isMaster"), F.lit("getLastError"), F.lit("count")), (e % 3 + 1).cast("int"))
    change = (F.when(e % 4 == 0, "{ $inc: { n: 1 } }").when(e % 4 == 1, "{ $set: { n: 1 } }")
              .when(e % 4 == 2, "{ $pull: { n: 1 } }").otherwise("{ n: 1 }"))
    body = (
        F.when(F.col("event_type") == "view", text(
            "query ", shop, ".views query: { $query: { uid: ", user, ", k: { $lte: ", k,
            " } }, $orderby: { ts: -1 } } planSummary: ", plan,
            " ntoreturn:10 ntoskip:0 keyUpdates:0 numYields:0 locks(micros) r:93 nreturned:0 reslen:20 0ms"))
        .when(F.col("event_type") == "click", text(
            "command ", shop, ".$cmd command: ", command, " { ", command,
            ": 1 } keyUpdates:0 numYields:0 reslen:37 0ms"))
        .when(F.col("event_type") == "purchase", text(
            "update ", shop, ".orders query: { _id: ", e, " } update: ", change,
            " nscanned:1 nscannedObjects:1 nMatched:1 nModified:1 keyUpdates:0 numYields:0 locks(micros) w:38 0ms"))
        .when(F.col("event_type") == "signup", text(
            "insert ", shop, ".users ninserted:1 keyUpdates:0 numYields:0 locks(micros) w:62 0ms"))
        .when(e % 2 == 0, text("getmore ", shop, ".views cursorid:1 ntoreturn:0 keyUpdates:0 nreturned:0 0ms"))
        .otherwise("connection accepted from 10.0.0.1")
    )
    return F.concat(prefix, body)


def dblog(spark: SparkSession, sf_dir: str, file: Column | None = None) -> DataFrame:
    return rows_as_lines(rows(spark, sf_dir, "events"), F.lit("db.log") if file is None else file,
                         F.col("event_id"), [dblog_line()])


DEEP = 120


def write_log_files(lines: DataFrame, folder: str, upto: int | None = None) -> None:
    """Writes each file of ``lines`` as a text file of that name, in line order; one task writes a file.

    With ``upto`` a file ends in the middle of its first line beyond that place, as a log that is being written does.
    Writing the same lines again gives the same file, and writing more of them a file that has grown.
    """
    def work(batches):
        import pyarrow as pa

        from opslens.sources.growing import located

        name, out = None, None
        for batch in batches:
            for file, pos, value in zip(*(batch[c].to_pylist() for c in ("file", "pos", "value"))):
                if file != name:
                    if out is not None:
                        out.close()
                    system, path = located(f"{folder}/{file}")
                    system.create_dir(path.rsplit("/", 1)[0])
                    name, out, cut = file, system.open_output_stream(path), False
                raw = value.encode() + b"\n"
                if upto is not None and pos > upto:
                    raw, cut = (b"" if cut else raw[:len(raw) // 2]), True
                out.write(raw)
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([name], pa.string())], names=["file"])

    lines.select("file", "pos", "value").repartition("file").sortWithinPartitions("file", "pos").mapInArrow(work, "file string").count()


def odd_dblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server log lines of sixteen kinds that the plain log does not have: operators, lists, deep and broken documents."""
    e, user = F.col("event_id"), F.col("user_id")
    ns = text("odd", user % 4, ".docs")
    deep = text("{ a: " * DEEP, user, " }" * DEEP)
    # (document, plan) of a query, or the text behind the connection.
    kinds = [
        (text("{ $and: [ { uid: ", user, " }, { k: { $lte: ", e, " } } ] }"), "COLLSCAN"),
        (text("{ following: { $in: [ ", user, ", ", e, " ] } }"), "IXSCAN { following: 1 }"),
        (text("{ $or: [ { _id: ", user, " }, { hosts: ", e, " } ] }"), "IXSCAN { _id: 1 }"),
        text("query ", ns, " planSummary: COLLSCAN ntoreturn:20 0ms"),
        text("query ", ns, " planSummary: EOF ntoreturn:20 0ms"),
        (text('{ status: "OPEN", cid: ObjectId(\'', e, "') }"), "EOF"),
        (deep, "IXSCAN { a: 1 }"),
        (text('{ name: /^O"Brien', user, "/ }"), "IXSCAN { name: 1 }"),
        (text('{ a: "two } words ', user, '", b: ', e, " }"), "EOF"),
        (text("{ a: { b: ", user, " }"), "IXSCAN { a: 1 }"),
        (text("{ a: [ ", user, ", 2 ], b: [ { c: ", e, " }, 5 ] }"), "COLLSCAN"),
        text("remove ", ns, " query: { _id: ", e, " } ndeleted:1 0ms"),
        text("insert ", ns, " ninserted:1 0ms"),
        F.concat(text("update ", ns, " query: { _id: ", e, " } update: { $set: "), deep, F.lit(" } nscanned:1 0ms")),
        F.lit("connection accepted from 10.0.0.1"),
        (F.lit("{ a: {}, b: [] }"), "IXSCAN { a: 1 }"),
    ]
    # A row writes the line of its own kind only.
    kind, untimed = e % len(kinds), 12
    time = F.when(kind == untimed, "yesterday").otherwise(text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), "+0000"))
    document = plan = other = F
    for i, parts in enumerate(kinds):
        if isinstance(parts, tuple):
            document, plan = document.when(kind == i, parts[0]), plan.when(kind == i, parts[1])
        else:
            other = other.when(kind == i, parts)
    find = text("query ", ns, " query: ", document, " planSummary: ", plan, " ntoreturn:10 0ms")
    queries = [i for i, parts in enumerate(kinds) if isinstance(parts, tuple)]
    line = text(time, " [conn", user, "] ", F.when(kind.isin(queries), find).otherwise(other))
    return rows_as_lines(rows(spark, sf_dir, "events"), F.lit("odd.log"), e, [line])


def event_time(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def access_line() -> Column:
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k")
    ip = text("10.0.", F.floor(user / 16), ".", user % 16)
    method = F.when(kind.isin("click", "purchase"), "POST").otherwise("GET")
    url = (F.when(kind == "click", text("/ping/v1/agent", user))
           .when(kind == "purchase", text("/ping/v2/agent", user)).otherwise(text("/", kind, "/", k)))
    return text(ip, " - - [", event_time("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "', method, " ", url,
                ' HTTP/1.1" 200 12 "-" "Client/', user % 3, '"')


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_as_lines(rows(spark, sf_dir, "events"), F.lit("access.log"), F.col("event_id"), [access_line()])


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.struct(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("i"), F.col("o_orderstatus").alias("g"))
    record = F.to_json(F.struct(
        F.when(F.col("o_orderstatus") == "O", "i").otherwise("u").alias("op"),
        text("shop.", F.col("o_orderpriority")).alias("ns"), document.alias("o")))
    return rows_as_lines(rows(spark, sf_dir, "orders"), F.lit("oplog.json"), F.col("o_orderkey"), [record])


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = (F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "purchase", "update")
          .otherwise(F.col("event_type")))
    return table(spark, sf_dir, "events").select(F.to_timestamp(F.concat(
        event_time("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00:00"))).alias("ts"), op.alias("op"))


OLD_PERF, NEW_PERF = "perf-F.log", "perf-O.log"


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-benchmark logs: each line item is one result, first line numbers restart the suite.

    The old log has no results of seven threads, so these have no baseline.
    """
    suite = [F.when(F.col("l_linenumber") == 1, line) for line in (
        "MongoDB shell version: 2.7.5-pre-", "connecting to: 127.0.0.1:27017/test", "db version: 2.7.5",
        "00112233445566778899aabbccddeeff00112233", "")]
    return rows_as_lines(
        rows(spark, sf_dir, "lineitem"), text("perf-", F.col("l_linestatus"), ".log"), F.col("row_id"),
        [*suite, text("Item.", F.col("l_returnflag")),
         F.when((F.col("l_linestatus") != "F") | (F.col("l_linenumber") != 7),
                text(F.col("l_linenumber"), "\t", cents(F.col("l_extendedprice"))))])


def grouped(value: Column, places: int) -> Column:
    """A number with thousands separators."""
    return F.format_number(value.cast(f"decimal(18,{places})"), places)


def before_rows() -> Column:
    return F.lit(-1).cast("bigint")


def after_rows() -> Column:
    return F.lit(1 << 40)


def sysbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per order priority: parameters, then one interval line per order.

    Priority 5 lacks a setting, priority 4 has one twice.
    """
    orders = table(spark, sf_dir, "orders")
    file = text("sysbench-", F.col("o_orderpriority"))
    setting = lambda name, value: text("Thread[main,5,main]  ", F.rpad(F.lit(name), 25, " "), "= ", value)
    digit = F.substring("o_orderpriority", 1, 1)
    head = rows_as_lines(orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), file, before_rows(), [
        setting("collections", F.lit("15")), setting("database name", F.lit("sbtest")),
        setting("writer threads", digit), setting("documents per collection", grouped(F.col("n"), 0)),
        setting("feedback seconds", F.lit("10")), F.when(digit != "5", setting("run seconds", F.lit("600"))),
        setting("oltp range size", F.lit("100")), setting("oltp point selects", F.lit("10")),
        setting("oltp simple ranges", F.lit("11")), setting("oltp sum ranges", F.lit("12")),
        setting("oltp order ranges", F.lit("13")), setting("oltp distinct ranges", F.lit("14")),
        setting("oltp index updates", F.lit("15")), setting("oltp non index updates", F.lit("16")),
        setting("write concern", F.lit("SAFE")), F.when(digit == "4", setting("write concern", F.lit("NORMAL"))),
    ])
    interval = text("Thread[Thread-66,5,main]", (F.col("o_orderkey") + 1) * 10, " seconds : cum tps=",
                    grouped(F.col("o_custkey") + 0.25, 2), " : int tps=", grouped(F.col("o_totalprice"), 2),
                    " : cum ips=0.00 : int ips=0.00")
    return head.unionByName(rows_as_lines(rows(spark, sf_dir, "orders"), file, F.col("o_orderkey"), [interval]))


def sysbench_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per market segment, one interval line per customer."""
    customer = table(spark, sf_dir, "customer")
    file = text("insert-", F.col("c_mktsegment"))
    head = rows_as_lines(customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")), file, before_rows(), [
        F.lit("Thread[main,5,main]  16 collections"), F.lit("Thread[main,5,main]  8 writer thread(s)"),
        text("Thread[main,5,main]  ", grouped(F.col("n"), 0), " documents per collection"),
        F.lit("Thread[main,5,main]  Feedback every 10 seconds(s)"),
        F.lit("Thread[main,5,main]  Feedback every -1 inserts(s)"), F.lit("Thread[main,5,main]  write concern = SAFE"),
    ])
    key = F.col("c_custkey")
    interval = text("Thread[Thread-2,5,main]", key, " inserts : ", (key + 1) * 10, " seconds : cum ips=",
                    grouped(key * 2 + 0.5, 2), " : int ips=", grouped(key + 0.75, 2))
    return head.unionByName(rows_as_lines(rows(spark, sf_dir, "customer"), file, key, [interval]))


def hammer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per event type: an interval line per event, then the final block."""
    events = table(spark, sf_dir, "events")
    file = text("hammer-", F.col("event_type"))
    interval = text(event_time("MMM dd HH:mm:ss"), "  Total send:  ", F.col("event_id"), "  slow:  0.00%  | Last avg(ms):  ",
                    cents(F.col("value")), "  send:  ", F.col("event_id"), "  | conn: 4")
    final = lambda name, value: text(F.lpad(F.lit(name), 40, " "), " : ", value)
    tail = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("value").alias("top"), F.count_distinct("user_id").alias("users"))
    block = rows_as_lines(tail, file, after_rows(), [
        F.lit("Final results:"), final("total send", F.col("n")), final("req/s", F.lit("9567.046208")),
        final("ack/s", text(F.col("n"), ".029541")), final("avg(ms)", cents(F.col("top"))),
        final("err ratio(%)", F.lit("10.00")), final("slow ratio(%)", F.lit("18.00")),
        final("last avg(ms)", F.lit("0.094658")), final("conn", F.col("users")),
    ])
    return rows_as_lines(rows(spark, sf_dir, "events"), file, F.col("event_id"), [interval]).unionByName(block)


def ycsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per nation: each customer adds a command line and an overall result."""
    key = F.col("c_custkey")
    return rows_as_lines(rows(spark, sf_dir, "customer"), text("ycsb-", F.col("c_nationkey")), key, [
        text("Command line: -db client -s -P workloads/w -threads ", key),
        text("[OVERALL], RunTime(ms), ", key),
        F.when(key % 2 == 1, text("[OVERALL], Throughput(ops/sec), ", key, ".25")),
    ])


def sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One simulation log per customer; only the report after the last marker counts."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    stats = lambda **fields: F.struct(*[value.alias(name) for name, value in fields.items()])
    def report(nodes: list[Column]) -> Column:
        return F.to_json(F.struct(
            F.lit("mongo-sim").alias("harness"), F.lit("shop").alias("workload"), key.alias("run_seconds"),
            F.array(F.struct(nation.alias("nThreads"))).alias("attributes"),
            F.struct(F.array(*nodes).alias("nodes")).alias("summary")))
    browse = stats(op_count=nation.cast("bigint"), op_lat_total_micros=key)
    buy = stats(op_count=key % 7, op_lat_total_micros=key * 2)
    nodes = [F.struct(browse.alias("browse")), F.struct(buy.alias("browse"))]
    return rows_as_lines(rows(spark, sf_dir, "customer"), text("sim-", key), key, [
        F.lit("Simulation configuration:"), F.lit("==== perf metrics ===="), report(nodes[1:]),
        F.lit("==== perf metrics ===="), report(nodes), F.lit("Script done")])


PIDSTAT_HEADER = ("#      Time      TGID       TID    %usr %system  %guest    %CPU   CPU   %MEM   kB_rd/s   kB_wr/s"
                  "   cswch/s nvcswch/s  Command")


def pidstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per server; each event is one block of a process row and three thread rows."""
    e, user = F.col("event_id"), F.col("user_id")
    row = lambda tid, switches, forced, name: text(
        " ", e, "  17  ", tid, "  1.00  0.50  0.00  ", cents(F.col("value")), "  3  ", user, ".25  ", e % 1000, ".00  ",
        e % 777, ".50  ", switches, ".00  ", forced, ".00  ", name)
    threads = [row(F.lit(str(20 + i)), user + i, e % 100 + i, f"|__worker{i}") for i in range(3)]
    return rows_as_lines(rows(spark, sf_dir, "events"), text("pidstat-10.0.0.", user % 4), e,
                         [F.lit(PIDSTAT_HEADER), row(F.lit("0"), F.lit(0), F.lit(0), "serverd"), *threads, F.lit("")])


def _shell(body: list) -> Column:
    lines = [F.lit("shell version: 2.6.3"), F.lit("connecting to: test"), F.lit("serverBuildInfo"), *body]
    return F.concat_ws("\n", *lines)


def server_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, build and storage-engine output per supplier."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    host = _shell([
        F.lit("{"), F.lit('\t"system" : {'), F.lit('\t\t"currentTime" : ISODate("2014-09-24T20:46:27.254Z"),'),
        text('\t\t"hostname" : "', F.col("s_name"), '",'), F.lit('\t\t"cpuAddrSize" : 64,'),
        text('\t\t"memSizeMB" : ', key * 16 + 1024, ","), text('\t\t"numCores" : ', nation + 1, ","),
        F.lit('\t\t"numaEnabled" : true'), F.lit("\t},"), F.lit('\t"os" : {'), F.lit('\t\t"type" : "Linux"'),
        F.lit("\t},"), F.lit('\t"extra" : {'), text('\t\t"pageSize" : NumberLong(', key + 4096, "),"),
        F.lit('\t\t"maxOpenFiles" : 1024'), F.lit("\t},"), F.lit('\t"ok" : 1'), F.lit("}")])
    build = _shell([F.lit("{"), text('\t"version" : "2.6.', nation, '",'), F.lit('\t"bits" : 64,'),
                    F.lit('\t"debug" : false'), F.lit("}")])
    engine = F.when(key % 3 == 0, _shell([F.lit("undefined")])).otherwise(
        _shell([F.lit("{"), F.lit('\t"name" : "wiredTiger"'), F.lit("}")]))
    return rows(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("server"), host.alias("host_text"), build.alias("build_text"), engine.alias("engine_text"))


def _counter_text(values: list[Column]) -> Column:
    names = ["insert", "query", "update", "delete", "getmore", "command"]
    lines = [text(f'\t\t"{name}" : ', value, "" if name == "command" else ",") for name, value in zip(names, values)]
    return _shell([F.lit("{"), F.lit('\t"opcounters" : {'), *lines, F.lit("\t}"), F.lit("}")])


def _proc_text(utime: Column, stime: Column) -> Column:
    return text("17 (serverd) S 1 17 17 0 -1 4202752 100 0 5 0 ", utime, " ", stime, " 0 0 20 0 25 0 1000")


def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and process ticks before and after one run per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    after = F.col("phase") == "after"
    plus = lambda base, more: base + F.when(after, more).otherwise(0)
    both = rows(spark, sf_dir, "orders").withColumn("phase", F.explode(F.array(F.lit("before"), F.lit("after"))))
    values = [plus(key, cust), plus(cust, F.lit(7)), key, F.lit(0), plus(F.lit(5), key % 11), F.lit(3)]
    return both.select(
        key.alias("run"), "phase", plus(key * 1000, F.lit(60000) + cust).alias("time_ms"),
        _counter_text(values).alias("counters_text"),
        _proc_text(plus(key, cust % 13), plus(cust, key % 5)).alias("proc_text"))


def sysbench_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and ticks around each capture of ``sysbench``, from totals per priority."""
    totals = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    after = F.col("phase") == "after"
    plus = lambda base, more: F.lit(base) + F.when(after, more).otherwise(0)
    n, s = F.col("n"), F.col("s")
    both = totals.withColumn("phase", F.explode(F.array(F.lit("before"), F.lit("after"))))
    values = [plus(100, n), plus(50, s), F.lit(1), F.lit(0), F.lit(5), F.lit(3)]
    return both.select(
        text("sysbench-", F.col("o_orderpriority")).alias("run"), "phase", plus(1000, n * 10).alias("time_ms"),
        _counter_text(values).alias("counters_text"), _proc_text(plus(10, n), plus(20, n * 2)).alias("proc_text"))


def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result file per nation, one row per customer."""
    customer = table(spark, sf_dir, "customer")
    file = text("csv-", F.col("c_nationkey"))
    head = rows_as_lines(customer.select("c_nationkey").distinct(), file, before_rows(), [F.lit("key,name,balance")])
    row = text(F.col("c_custkey"), ",", F.col("c_name"), ",", cents(F.col("c_acctbal")))
    return head.unionByName(rows_as_lines(rows(spark, sf_dir, "customer"), file, F.col("c_custkey"), [row]))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed-sum input: customer and order amount in cents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("amount"),
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))
